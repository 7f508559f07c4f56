"""Latency analytics over a table of timed runs (build, session, run, start, stop, ms), here made from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.fixtures import table
from plumbline.operators.metrics import r9
from plumbline.operators.ordered import percentiles, running

#: Spread of p50 in per cent beyond which a build is unstable; a session is discarded for a run or gap beyond
#: the larger of so many seconds and so many median runs; and discarded sessions beyond which a build fails.
SPREAD_PCT, LIMIT_S, MEDIAN_RUNS, DISCARDED = 10.0, 1.0, 20, 3


def timings(spark: SparkSession, sf: str) -> DataFrame:
    """Timed runs: a build for each event type, a session for each user."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("build"), F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.abs("value").alias("ms"))
    run = F.row_number().over(Window.partitionBy("build", "session").orderBy("us", "event_id"))
    return e.select("build", "session", run.alias("run"), (F.col("us") / 1e6).alias("start"), (F.col("us") / 1e6 + F.col("ms") / 1000).alias("stop"), "ms")


def lat_summarise(t: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, population deviation, least, p50, p95, p99 (interpolated) and most. A session's runs are few; a build's may be
    any number, so their percentiles are looked up in running counts."""
    shares, few = [0.5, 0.95, 0.99], "session" in keys
    p = [F.percentile("ms", F.array(*map(F.lit, shares))).alias("p")] if few else []
    own = t.groupBy(*keys).agg(F.avg("ms").alias("mean"), F.stddev_pop("ms").alias("std"), F.min("ms").alias("least"), *p, F.max("ms").alias("most"))
    own = own if few else own.join(percentiles(t, keys, "ms", shares), keys)
    return own.select(*keys, r9(F.col("mean")).alias("mean_ms"), F.round("std", 6).alias("std_ms"), r9(F.col("least")).alias("min_ms"), *[r9(F.col("p")[i]).alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))], r9(F.col("most")).alias("max_ms"))


def lat_sessions(t: DataFrame) -> DataFrame:
    """Percentiles of each session, then medians over the sessions; interquartile spread of p50 in per cent."""
    each = lat_summarise(t, ["build", "session"])
    own = each.groupBy("build").agg(*[F.median(c).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")], F.min("p50_ms").alias("fastest"), F.max("p50_ms").alias("slowest"), F.percentile("p50_ms", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = (F.col("q")[1] - F.col("q")[0]) / F.col("p50_ms") * 100
    return own.select("build", *[r9(F.col(c)).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms", "fastest", "slowest")], r9(spread).alias("spread_pct"), (spread > SPREAD_PCT).alias("unstable"))


def lat_combine(t: DataFrame, least: int = 2) -> DataFrame:
    """The older form: medians over sessions, spread of p50 by range and by quartiles; builds with too few sessions drop out."""
    each = lat_summarise(t, ["build", "session"])
    own = each.groupBy("build").agg(F.count("*").alias("sessions"), *[F.median(c).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")], F.min("p50_ms").alias("lo"), F.max("p50_ms").alias("hi"), F.percentile("p50_ms", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).filter(F.col("sessions") >= least)
    return own.select("build", "sessions", *[r9(F.col(c)).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms")], r9((F.col("hi") - F.col("lo")) / F.col("p50_ms") * 100).alias("p50_spread_pct"), r9((F.col("q")[1] - F.col("q")[0]) / F.col("p50_ms") * 100).alias("p50_iqr_pct"))


def lat_interruption(t: DataFrame) -> DataFrame:
    """Per session: longest run and gap against max(1 s, 20 x the median run); interrupted sessions are discarded."""
    w = Window.partitionBy("build", "session").orderBy("run")
    own = t.withColumns({"s": F.col("ms") / 1000, "gap": F.col("start") - F.lag("stop").over(w)})
    own = own.groupBy("build", "session").agg(F.max("s").alias("run_s"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap_s"), F.greatest(F.lit(LIMIT_S), MEDIAN_RUNS * F.median("s")).alias("limit_s"))
    return own.select("build", "session", F.round("run_s", 6).alias("longest_run_s"), F.round("gap_s", 3).alias("longest_gap_s"), F.round("limit_s", 6).alias("limit_s"), ((F.col("run_s") > F.col("limit_s")) | (F.col("gap_s") > F.col("limit_s"))).alias("discarded"))


def lat_discard_limit(sessions: DataFrame, most: int = DISCARDED) -> DataFrame:
    return sessions.groupBy("build").agg(F.count_if("discarded").alias("discarded")).withColumn("failed", F.col("discarded") > most)


def lat_window(t: DataFrame) -> DataFrame:
    """First start and last end of the timed runs, UTC."""
    text = lambda c: F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.groupBy("build").agg(F.min("start").alias("a"), F.max("stop").alias("b")).select("build", text(F.col("a")).alias("first_start"), text(F.col("b")).alias("last_end"))


def lat_rates(t: DataFrame) -> DataFrame:
    """Runs a second of each pass (session), and the median pass of each build."""
    each = t.groupBy("build", "session").agg((F.count("*") / (F.sum("ms") / 1000)).alias("rate"))
    return each.groupBy("build").agg(F.count("*").alias("passes"), r9(F.median("rate")).alias("median_rate"), r9(F.min("rate")).alias("slowest_rate"))


def lat_rows_sorted(t: DataFrame) -> DataFrame:
    own = lat_summarise(t, ["build", "session"]).select("build", "session", "p50_ms", F.struct("build", -F.col("p50_ms"), "session").alias("_order"), F.lit(1).alias("_one"))
    return running(own, [], "_order", {"_one": "_before"}).select("build", "session", "p50_ms", (F.col("_before") + 1).alias("place"))


def speed_ratio(t: DataFrame, reference: str | None = None) -> DataFrame:
    """Each build's p50 over the reference's in every session that both have, and whether it is slower. The reference is
    the build of that name, or the first one by name."""
    each = lat_summarise(t, ["build", "session"]).select("build", "session", "p50_ms")
    named = each.agg(F.min("build").alias("_first")) if reference is None else t.sparkSession.createDataFrame([(reference,)], "_first string")
    each = each.crossJoin(F.broadcast(named))  # one row
    old = each.filter("build = _first").select("session", F.col("p50_ms").alias("old"))
    own = each.filter("build <> _first").join(old, "session")
    return own.select("build", "session", r9(F.col("p50_ms") / F.col("old")).alias("ratio"), (F.col("p50_ms") > F.col("old")).alias("slower"))


QUERIES = {
    "lat_summarise": lambda s, d: lat_summarise(timings(s, d), ["build"]),
    "lat_sessions": lambda s, d: lat_sessions(timings(s, d)),
    "lat_combine": lambda s, d: lat_combine(timings(s, d)),
    "lat_interruption": lambda s, d: lat_interruption(timings(s, d)),
    "lat_discard_limit": lambda s, d: lat_discard_limit(lat_interruption(timings(s, d))),
    "lat_window": lambda s, d: lat_window(timings(s, d)),
    "lat_rates": lambda s, d: lat_rates(timings(s, d)),
    "lat_rows_sorted": lambda s, d: lat_rows_sorted(timings(s, d)),
    "cmp_speed_ratio": lambda s, d: speed_ratio(timings(s, d)),
}
_T = """with t as materialized (select build, session, row_number() over (partition by build, session order by us, event_id)::int run, us / 1e6::double as start, us / 1e6::double + ms / 1000 as stop, ms from
 (select event_type build, user_id session, epoch_us(ts) us, event_id, abs(value) ms from events)),
s as materialized (select build, session, round(avg(ms), 9) mean_ms, round(quantile_cont(ms, 0.5::double), 9) p50_ms, round(quantile_cont(ms, 0.95::double), 9) p95_ms, round(quantile_cont(ms, 0.99::double), 9) p99_ms from t group by 1, 2) """
_IQR = "(quantile_cont(p50_ms, 0.75::double) - quantile_cont(p50_ms, 0.25::double)) / median(p50_ms) * 100"
_INT = """i as (select build, session, max(ms / 1000) r, coalesce(max(gap), 0) g, greatest(1.0::double, 20 * median(ms / 1000)) l from (select *, start - lag(stop) over (partition by build, session order by run) gap from t) group by 1, 2)"""
ORACLE = {
    "lat_summarise": f"{_T} select build, round(avg(ms), 9) mean_ms, round(stddev_pop(ms), 6) std_ms, round(min(ms), 9) min_ms, round(quantile_cont(ms, 0.5::double), 9) p50_ms, round(quantile_cont(ms, 0.95::double), 9) p95_ms, round(quantile_cont(ms, 0.99::double), 9) p99_ms, round(max(ms), 9) max_ms from t group by 1",
    "lat_sessions": f"{_T} select build, round(median(p50_ms), 9) p50_ms, round(median(p95_ms), 9) p95_ms, round(median(p99_ms), 9) p99_ms, min(p50_ms) fastest, max(p50_ms) slowest, round({_IQR}, 9) spread_pct, {_IQR} > 10 unstable from s group by 1",
    "lat_combine": f"{_T} select build, count(*) sessions, round(median(mean_ms), 9) mean_ms, round(median(p50_ms), 9) p50_ms, round(median(p95_ms), 9) p95_ms, round(median(p99_ms), 9) p99_ms, round((max(p50_ms) - min(p50_ms)) / median(p50_ms) * 100, 9) p50_spread_pct, round({_IQR}, 9) p50_iqr_pct from s group by 1 having count(*) >= 2",
    "lat_interruption": f"{_T}, {_INT} select build, session, round(r, 6) longest_run_s, round(g, 3) longest_gap_s, round(l, 6) limit_s, r > l or g > l discarded from i",
    "lat_discard_limit": f"{_T}, {_INT} select build, count(*) filter (r > l or g > l) discarded, count(*) filter (r > l or g > l) > 3 failed from i group by 1",
    "lat_window": f"{_T} select build, strftime(to_timestamp(floor(min(start))) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') first_start, strftime(to_timestamp(floor(max(stop))) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') last_end from t group by 1",
    "lat_rates": f"{_T} select build, count(*) passes, round(median(r), 9) median_rate, round(min(r), 9) slowest_rate from (select build, session, count(*) / (sum(ms) / 1000) r from t group by 1, 2) group by 1",
    "lat_rows_sorted": f"{_T} select build, session, p50_ms, row_number() over (order by build, p50_ms desc, session) place from s",
    "cmp_speed_ratio": f"{_T} select a.build, a.session, round(a.p50_ms / b.p50_ms, 9) ratio, a.p50_ms > b.p50_ms slower from s a join s b using (session) where b.build = (select min(build) from s) and a.build <> b.build",
}
