"""Streams over `events`: tumbling, sliding and session windows with a watermark, count alarms with carried state, running
aggregates in update mode, a join with a static table, de-duplication.

`Feed` lands the events in deliveries: time ranges one after another, with rows delivered twice, and last a delivery of
very late rows. After each one the stream is started on the same checkpoint and takes what is there (available-now
trigger), so every query also stops and resumes; a production job leaves the trigger out. The oracle of each is its
batch twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixtures import table
from plumbline.operators.ordered import percentiles, running
from plumbline.shared import shared_path, written

N = 100
DELAY = "1 day"
#: Rows delivered last, when the watermark has passed them long ago (SQL; `most` is the last event time).
LATE = "event_id % 50 = 7 and ts < most - interval 15 days"
#: Rows delivered a second time, in the same delivery or in the next one.
TWICE, AGAIN = "event_id % 10 = 3", "event_id % 10 = 4"


class Feed:
    """Deliveries of the events below one folder."""

    def __init__(self, spark: SparkSession, sf: str, repeats: bool = False, parts: int = 2):
        self.spark, self.path, self.parts, self.repeats = spark, shared_path(spark, "events"), parts, repeats
        events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        self.schema = events.schema
        first, most = events.agg(F.min("ts"), F.max("ts")).first()
        part = F.least(F.lit(parts - 1), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * parts / (F.unix_micros(F.lit(most)) - F.unix_micros(F.lit(first)) + 1))) if first else F.lit(0)
        late = F.expr(LATE.replace("most", f"timestamp_micros({int(most.timestamp() * 1e6)})")) if first else F.lit(False)
        self.rows = events.withColumn("part", F.when(late, parts).otherwise(part).cast("int"))

    def deliver(self, i: int) -> None:
        own = self.rows.filter(F.col("part") == i).drop("part")
        if self.repeats:
            own = own.union(own.filter(TWICE)).union(self.rows.filter((F.col("part") == i - 1) & F.expr(AGAIN)).drop("part"))
        own.write.mode("append").parquet(self.path)

    def run(self, query: Callable[[DataFrame], DataFrame], sink: Callable, mode: str, name: str) -> None:
        """Delivers part after part; each time the stream goes on from its checkpoint. Columns of events but `props`."""
        state = shared_path(self.spark, f"{name}-state")
        for i in range(self.parts + 1):
            self.deliver(i)
            stream = self.spark.readStream.schema(self.schema).parquet(self.path).drop("props")
            sink(query(stream).writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)).awaitTermination()


def run_append(feed: Feed, query: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What the stream appended to its sink."""
    path, spark = shared_path(feed.spark, name), feed.spark
    feed.run(query, lambda w: w.format("parquet").start(path), "append", name)
    return spark.read.schema(query(spark.createDataFrame([], feed.schema).drop("props")).schema).parquet(path)


def run_update(feed: Feed, query: Callable[[DataFrame], DataFrame], keys: list[str], name: str) -> DataFrame:
    """The last row of each key. A batch gives the keys that changed; its folder is named by the batch, so that a batch
    that runs again after a failure replaces its own rows."""
    path, spark = shared_path(feed.spark, name), feed.spark
    feed.run(query, lambda w: w.foreachBatch(lambda df, batch: df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/b{batch}")).start(), "update", name)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, "_last.*")


def windowed(events: DataFrame, window: Column, key: str, delay: str = DELAY) -> DataFrame:
    """Mean of a value per key and window; a window is written once the watermark has passed its end, and rows that come
    after that are dropped."""
    own = events.withWatermark("ts", delay).groupBy(window.alias("w"), F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"), F.sum(F.round("value", 4).cast("decimal(18,4)")).alias("total"))
    return own.select("key", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n", F.round(F.col("total").cast("double") / F.col("n"), 6).alias("mean"))


def count_alarm(batch: DataFrame, carried: DataFrame, threshold: float, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(windows, carried): per key, every n events their mean and whether it is strictly below the threshold.

    carried (event_type, window_no, count, total) is the unfinished window of each key. Events are numbered in blocks
    of their order, so that a key with a third of all events is spread over tasks; only sums go on.
    """
    own = batch.select("event_type", F.struct("ts", "event_id").alias("_order"), "value", F.lit(1).alias("_one"))
    placed = running(own, ["event_type"], "_order", {"_one": "_before"}).join(carried.select("event_type", "window_no", "count"), "event_type", "left")
    number = F.coalesce("window_no", F.lit(0)) + F.floor((F.coalesce("count", F.lit(0)) + F.col("_before")) / n)
    sums = placed.select("event_type", number.alias("window_no"), F.lit(1).alias("count"), F.col("value").alias("total")).unionByName(carried)
    sums = written(batch.sparkSession, sums.groupBy("event_type", "window_no").agg(F.sum("count").alias("count"), F.sum("total").alias("total")), "windows")
    mean = F.round(F.col("total") / F.col("count"), 6)
    done = sums.filter(F.col("count") == n).select("event_type", "window_no", mean.alias("mean"), (mean < threshold).alias("fired"))
    # a key's next window, where its last one is full
    last = sums.groupBy("event_type").agg(F.max(F.struct("window_no", "count", "total")).alias("w"))
    full = F.col("w.count") == n
    return done, last.select("event_type", (F.col("w.window_no") + full.cast("int")).alias("window_no"), F.when(full, 0).otherwise(F.col("w.count")).alias("count"), F.when(full, 0.0).otherwise(F.col("w.total")).alias("total"))


def q_time_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling days and sliding days of each event type, sessions of each user."""
    kinds = {"tumbling": (F.window("ts", "1 day"), "event_type"), "sliding": (F.window("ts", "1 day", "12 hours"), "event_type"), "session": (F.session_window("ts", "6 hours"), "user_id")}
    out = None
    for kind, (window, key) in kinds.items():
        own = run_append(Feed(spark, sf), lambda e, w=window, k=key: windowed(e, w, k), f"st_{kind}").withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


def q_count_alarm(spark: SparkSession, sf: str) -> DataFrame:
    """State goes from batch to batch by tables named after the batch: one that runs again replaces its own."""
    path = shared_path(spark, "st_count_alarm")
    empty = spark.createDataFrame([], "event_type string, window_no long, count long, total double")

    def step(batch: DataFrame, number: int) -> None:
        carried = batch.sparkSession.read.schema(empty.schema).parquet(f"{path}/state/b{number - 1}") if number else empty
        done, rest = count_alarm(batch, carried, 50.0)
        done.write.mode("overwrite").parquet(f"{path}/windows/b{number}")
        rest.write.mode("overwrite").parquet(f"{path}/state/b{number}")

    Feed(spark, sf).run(lambda e: e, lambda w: w.foreachBatch(step).start(), "append", "st_count_alarm")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/windows")


def q_threshold_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events below their key's threshold from a static table of a row a key."""
    limits = percentiles(table(spark, sf, "events"), ["event_type"], "value", [0.01]).select("event_type", F.round(F.col("p")[0], 9).alias("threshold"))
    limits = written(spark, limits, "thresholds")
    return run_append(Feed(spark, sf), lambda e: e.join(limits, "event_type").filter("value < threshold").select("event_id", "event_type", "value"), "st_threshold_join")


def q_running(spark: SparkSession, sf: str) -> DataFrame:
    query = lambda e: e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 50).alias("low")).withColumn("rate", F.round(F.col("low") / F.col("n"), 9))
    return run_update(Feed(spark, sf), query, ["event_type"], "st_running_accuracy")


def q_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each event once: deliveries of an event that the state still holds drop out, and so do those that the watermark has
    passed (after which the state forgets them)."""
    query = lambda e: e.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    return run_append(Feed(spark, sf, repeats=True), query, "st_dedup")


QUERIES = {"st_time_windows": q_time_windows, "st_count_alarm": q_count_alarm, "st_threshold_join": q_threshold_join, "st_running_accuracy": q_running, "st_dedup": q_dedup}
_LATE = LATE.replace("most", "(select max(ts) from events)")
_MEAN = "count(*) n, round(sum(round(value, 4)::decimal(18,4))::double / count(*), 6) mean"
ORACLE = {
    "st_time_windows": f"""with e as (select * from events where not ({_LATE})),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) k from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hours then 0 else 1 end new from e)),
w as (select 'tumbling' kind, event_type as key, date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as stop, {_MEAN} from e group by 1, 2, 3, 4
 union all select 'sliding', event_type, start, start + interval 1 day, {_MEAN} from (select *, time_bucket(interval 12 hours, ts, timestamp '1970-01-01') - h * interval 12 hours as start from e cross join range(0, 2) r(h)) group by 1, 2, 3, 4
 union all select 'session', user_id::varchar, min(ts), max(ts) + interval 6 hours, {_MEAN} from s group by user_id, k)
select * from w where stop <= (select max(ts) from e) - interval 1 day""",
    "st_count_alarm": f"select event_type, w window_no, round(avg(value), 6) mean, round(avg(value), 6) < 50 fired from (select *, (row_number() over (partition by event_type order by ({_LATE}), ts, event_id) - 1) // 100 w from events) group by 1, 2 having count(*) = 100",
    "st_threshold_join": "select event_id, event_type, value from events join (select event_type, round(quantile_cont(value, 0.01::double), 9) threshold from events group by 1) using (event_type) where value < threshold",
    "st_running_accuracy": "select event_type, count(*) n, count(*) filter (value < 50) low, round(count(*) filter (value < 50) / count(*)::double, 9) rate from events group by 1",
    "st_dedup": f"select event_id, event_type from events where not ({_LATE})",
}
