"""Count alarms by a keyed state operator.

`streams.count_alarm` numbers a key's events over the whole key, in blocks, and carries sums in tables. Where each lane of
a key (a user group, a device) is watched for itself, state belongs to (key, lane): a value state holds the unfinished
window of each, Spark keeps and restores it, and a key with a third of all events is spread over its lanes. With `idle`
given, an event-time timer closes a window that got no event for so long, and forgets the lane.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.streaming.streams import N, Feed, run_append

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "event_type string, lane int, window_no long, n int, mean double, fired boolean"
#: Lanes that the events of a key are dealt into.
LANES = 4


class CountWindows(StatefulProcessor):
    """Every `n` events of a (key, lane), in the order of (ts, event_id) inside a batch: their mean, and whether it is
    strictly below the threshold. One value state: number, events and sum of the unfinished window."""

    def __init__(self, threshold: float, n: int = N, idle_ms: int = 0):
        self.threshold, self.n, self.idle_ms = threshold, n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "window_no long, n int, total double, timer long")

    def _row(self, key: Any, number: np.ndarray, n: np.ndarray, total: np.ndarray) -> pd.DataFrame:
        mean = np.round(total / n, 6)
        return pd.DataFrame({"event_type": key[0], "lane": np.int32(key[1]), "window_no": number.astype(np.int64), "n": n.astype(np.int32), "mean": mean, "fired": mean < self.threshold})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")  # one delivery of one lane
        number, held, total, timer = self.open.get() if self.open.exists() else (0, 0, 0.0, 0)
        values = own["value"].to_numpy(float)
        place = held + np.arange(len(values))
        starts = np.flatnonzero((place % self.n == 0) | (np.arange(len(values)) == 0))
        sums = np.add.reduceat(values, starts)
        sums[0] += total if held else 0.0
        counts = np.diff(np.append(place[starts], held + len(values)))
        counts[0] += held
        numbers = number + place[starts] // self.n
        full = counts == self.n
        if full.any():
            yield self._row(key, numbers[full], counts[full], sums[full])
        last = (int(numbers[-1]) + 1, 0, 0.0) if full[-1] else (int(numbers[-1]), int(counts[-1]), float(sums[-1]))
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = int(own["ts"].iloc[-1].timestamp() * 1000) + self.idle_ms
            self.handle.registerTimer(timer)
        self.open.update((*last, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        number, held, total, _ = self.open.get() if self.open.exists() else (0, 0, 0.0, 0)
        self.open.clear()
        if held:
            yield self._row(key, np.array([number]), np.array([held]), np.array([total]))

    def close(self) -> None:
        pass


def keyed_alarm(events: DataFrame, threshold: float, n: int = N, lanes: int = LANES, delay: str | None = None, idle_ms: int = 0) -> DataFrame:
    """Windows of a stream of events (event_type, user_id, ts, event_id, value); a lane is the user's number modulo `lanes`.
    `idle_ms` needs `delay`, the watermark's."""
    own = events.select("event_type", F.coalesce(F.pmod("user_id", F.lit(lanes)), F.lit(0)).cast("int").alias("lane"), "ts", "event_id", "value")
    own = own.withWatermark("ts", delay) if delay else own
    return own.groupBy("event_type", "lane").transformWithStateInPandas(CountWindows(threshold, n, idle_ms), OUT, "Append", "EventTime" if idle_ms else "None")


def with_state_store(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Runs streams with the state store that keyed state needs, and leaves the session's setting as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def q_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return with_state_store(spark, lambda: run_append(Feed(spark, sf), lambda e: keyed_alarm(e, 50.0), "st_keyed_alarm")).drop("n")


QUERIES = {"st_keyed_alarm": q_keyed}
ORACLE = {
    "st_keyed_alarm": f"""with e as (select *, ts < (select max(ts) from events) - interval 15 days and event_id % 50 = 7 late from events),
r as (select *, (user_id % {LANES})::int lane, row_number() over (partition by event_type, user_id % {LANES} order by late, ts, event_id) - 1 k from e)
select event_type, lane, k // {N} window_no, round(avg(value), 6) mean, round(avg(value), 6) < 50 fired from r group by 1, 2, 3 having count(*) = {N}""",
}
