"""Quantile sketches (KLL) beside the exact percentiles: mergeable, of bounded size, for streams of batches and for unions
of calibration batches. A sketch of parameter k errs in rank by about 2.3 / k (at 99 per cent confidence), whatever the
number of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.latency import timings
from plumbline.operators.metrics import r9
from plumbline.operators.quantise import calibration, long, vectors
from plumbline.shared import written

#: Sketch parameter, and the error in rank that it keeps below.
K, RANK_ERROR = 800, 0.01


def sketched(df: DataFrame, keys: list[str], value: str, k: int = K, batch: list[str] | None = None) -> DataFrame:
    """keys (and `batch`), n and the sketch of the values; nulls and NaNs are no values. A key without values has none."""
    own = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return own.groupBy(*keys, *(batch or [])).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of several batches as one each: keys, n, sketch. Sketches add up in pairs, in any order."""
    all_ = F.reduce(F.slice("_all", 2, F.size("_all")), F.col("_all")[0], lambda a, b: F.kll_sketch_merge_double(a, b))
    own = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("sketch").alias("_all"))  # a few kilobytes a batch
    return own.select(*keys, "n", all_.alias("sketch"))


def quantiles(sketch: Column, shares: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, shares)))


def rank_errors(df: DataFrame, sketches: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, share and how far the sketch's quantile is from that share of the values, in rank: measured exactly, by counting
    the values below it and up to it."""
    found = written(df.sparkSession, sketches.select(*keys, "n", quantiles(F.col("sketch"), shares).alias("_q")), "quantiles")
    q = lambda i: F.col("_q")[i]
    counts = [c.alias(f"{n}{i}") for i in range(len(shares)) for n, c in (("_b", F.count_if(F.col(value) < q(i))), ("_u", F.count_if(F.col(value) <= q(i))))]
    own = df.join(found, keys).groupBy(*keys).agg(F.first("n").alias("n"), *counts)
    errors = [F.struct(F.lit(p).alias("share"), F.greatest(F.lit(0.0), F.col(f"_b{i}") / F.col("n") - p, p - F.col(f"_u{i}") / F.col("n")).alias("error")) for i, p in enumerate(shares)]
    return own.select(*keys, "n", F.explode(F.array(*errors)).alias("e")).select(*keys, "n", "e.*")


def q_range_sketch(df: DataFrame, p: float = 0.9999, batches: int = 2) -> DataFrame:
    """channel, lo, hi: the symmetric percentile range from sketches of |x| of calibration batches, put together."""
    rows = long(calibration(df)).withColumn("batch", F.pmod(F.xxhash64("item"), F.lit(batches)))
    ends = rows.groupBy("channel").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    own = merged(sketched(rows.withColumn("x", F.abs("x")), ["channel"], "x", batch=["batch"]), ["channel"])
    own = own.withColumn("t", quantiles(F.col("sketch"), [p])[0]).join(ends, "channel")
    return own.select("channel", r9(F.greatest(F.col("a"), -F.col("t"))).alias("lo"), r9(F.least(F.col("b"), F.col("t"))).alias("hi"))


def q_range(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the sketch of two batches is within its error in rank, per channel and share."""
    rows = long(calibration(vectors(spark, sf))).withColumn("x", F.abs("x")).withColumn("batch", F.pmod("item", F.lit(8)))
    own = merged(sketched(rows, ["channel"], "x", batch=["batch"]), ["channel"])
    return rank_errors(rows, own, ["channel"], "x", [0.5, 0.99, 0.9999]).select("channel", "n", "share", (F.col("error") <= RANK_ERROR).alias("fits"))


def q_latency(spark: SparkSession, sf: str) -> DataFrame:
    """The same for run times: one sketch for each day of a build, put together by build."""
    rows = timings(spark, sf).withColumn("day", F.floor(F.col("start") / 86_400))
    own = merged(sketched(rows, ["build"], "ms", batch=["day"]), ["build"])
    return rank_errors(rows, own, ["build"], "ms", [0.5, 0.95, 0.99]).select("build", "n", "share", (F.col("error") <= RANK_ERROR).alias("fits"))


QUERIES = {"q_range_percentile_sketch": q_range, "lat_summarise_sketch": q_latency}
_SHARES = "cross join (values ({}::double), ({}::double), ({}::double)) s(share)"
ORACLE = {
    "q_range_percentile_sketch": f"select channel, n, share, true fits from (select unnest(range(0, len(embedding)))::int channel, count(*) n from embeddings where vec_id % 4 = 0 group by 1) {_SHARES.format(0.5, 0.99, 0.9999)}",
    "lat_summarise_sketch": f"select build, n, share, true fits from (select event_type build, count(*) n from events group by 1) {_SHARES.format(0.5, 0.95, 0.99)}",
}
