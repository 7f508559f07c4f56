"""Windows of confidence and the alarm: blocks of a seeded order and random windows, without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.fixtures import duck
from plumbline.operators.metrics import r9, scored
from plumbline.operators.splits import ranked
from plumbline.shared import written

#: Items of a window, and random windows that a threshold is taken from.
N, WINDOWS = 100, 10_000


def win_consecutive(df: DataFrame, keys: list[str], value: str = "confidence", n: int = N, seed: int | str = 3) -> DataFrame:
    """Means of non-overlapping blocks of n items in one seeded order, the same for every key; the tail drops out."""
    place = ranked(df.select("item").distinct(), seed)
    blocks = df.join(place, "item").withColumn("window", F.floor((F.col("rn") - 1) / n))
    return blocks.groupBy(*keys, "window").agg(F.count("*").alias("m"), F.avg(value).alias("mean")).filter(F.col("m") == n).select(*keys, "window", F.round("mean", 9).alias("mean"))


def attempts(items: int, n: int) -> int:
    """Draws with replacement that hold n different ones of the items but for a negligible chance: mean and 12 deviations."""
    shares = [(items - k) / items for k in range(n)]
    return math.ceil(sum(1 / p for p in shares) + 12 * math.sqrt(sum((1 - p) / p**2 for p in shares))) + 10


def win_random(df: DataFrame, keys: list[str], value: str = "confidence", n: int = N, windows: int = WINDOWS, seed: int = 4) -> DataFrame:
    """Means of random windows of n different items, the same items for every key; windows may share items.

    A window's items are the first n different places that hashes of (window, draw) name, so the work of drawing does
    not grow with the items. Fewer than n items give no windows.
    """
    spark = df.sparkSession
    place = written(spark, ranked(df.select("item").distinct(), seed), "places")
    items = place.count()
    if items < n:
        windows, draws = 0, n
    else:
        draws = attempts(items, n)
    own = spark.range(windows).select(F.col("id").alias("window"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("j"))
    own = own.withColumn("rn", F.conv(F.substring(F.md5(F.concat_ws("|", "window", "j", F.lit(str(seed)))), 1, 12), 16, 10).cast("long") % max(items, 1) + 1)
    first = own.groupBy("window", "rn").agg(F.min("j").alias("j"))
    picked = first.withColumn("k", F.row_number().over(Window.partitionBy("window").orderBy("j"))).filter(F.col("k") <= n)  # `draws` rows a window
    rows = df.select(*keys, "item", value).join(place, "item").join(picked.select("window", "rn"), "rn")
    means = rows.groupBy(*keys, "window").agg(F.count("*").alias("m"), F.avg(value).alias("mean"))
    short = F.raise_error(F.lit("a window has too few different items")).cast("double")
    return means.select(*keys, "window", F.when(F.col("m") == n, F.round("mean", 9)).otherwise(short).alias("mean"))


def alarm_threshold(windows: DataFrame, keys: list[str], percentile: float = 0.01) -> DataFrame:
    return windows.groupBy(*keys).agg(r9(F.percentile("mean", F.lit(percentile))).alias("threshold"))


def alarm_fires(windows: DataFrame, thresholds: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Share of windows whose mean is strictly below the threshold."""
    return windows.join(written(thresholds.sparkSession, thresholds, "thresholds"), on).groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if(F.col("mean") < F.col("threshold")).alias("fired"), r9(F.avg((F.col("mean") < F.col("threshold")).cast("double"))).alias("rate"))


def alarm_judge(fires: DataFrame, harmful: list[str], least: float = 0.90, most_clean: int = 2) -> DataFrame:
    """Per build: at least 90% of the harmful windows fire, and at most two clean ones."""
    is_harmful = F.col("cond_id").isin(harmful)
    own = fires.groupBy("model", "build").agg(F.sum(F.when(is_harmful, F.col("fired"))).alias("hits"), F.sum(F.when(is_harmful, F.col("windows"))).alias("harmful_windows"), F.sum(F.when(F.col("cond_id") == "clean", F.col("fired"))).alias("clean_fires"))
    ok = (F.col("hits") >= least * F.col("harmful_windows")) & (F.col("clean_fires") <= most_clean)
    return own.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


KEYS = ["model", "build", "cond_id"]


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    clean = scored(spark, sf, conds=["clean"]).filter("split = 'tuning'")
    return alarm_threshold(win_random(clean, ["model", "build"]), ["model", "build"])


def fires(spark: SparkSession, sf: str) -> DataFrame:
    windows = win_consecutive(scored(spark, sf).filter("split = 'test'"), KEYS)
    return alarm_fires(windows, thresholds(spark, sf), KEYS, ["model", "build"])


QUERIES = {
    "win_consecutive": lambda s, d: win_consecutive(scored(s, d).filter("split = 'test'"), KEYS),
    "win_random": lambda s, d: win_random(scored(s, d, conds=["clean"]).filter("split = 'tuning'"), ["model", "build"]),
    "alarm_threshold": thresholds,
    "alarm_fires": fires,
    "alarm_judge": lambda s, d: alarm_judge(fires(s, d), ["demo/fade/5", "demo/jitter/5"]),
}


def _windows(rows: str, keys: str, seed: str) -> str:
    return f"select {keys}, w::bigint as window, round(avg(confidence), 9) mean from (select o.*, (rn - 1) // 100 w from {rows} o join (select item, row_number() over (order by md5(item || '|{seed}'), item) rn from (select distinct item from {rows})) using (item)) group by {keys}, w having count(*) = 100"


_TUNE = "tune as materialized (select * from outcomes where cond_id = 'clean' and split = 'tuning')"
_RANDOM = """select model, build, w as window, round(avg(confidence), 9) mean from tune join
 (select item, row_number() over (order by md5(item || '|4'), item) rn from (select distinct item from tune)) using (item) join
 (select w, rn from (select w, rn, row_number() over (partition by w order by j) k from (select w, rn, min(j) j from (select w, j, ('0x' || substr(md5(w || '|' || j || '|4'), 1, 12))::bigint % (select count(distinct item) from tune) + 1 rn from range(0, 10000) a(w) cross join range(0, 500) b(j)) group by 1, 2)) where k <= 100) using (rn) group by 1, 2, 3 having count(*) = 100"""
_TEST = f"test as materialized (select * from outcomes where split = 'test'), tested as ({_windows('test', 'model, build, cond_id', '3')})"
_THR = f"{_TUNE}, thr as (select model, build, round(quantile_cont(mean, 0.01::double), 9) threshold from ({_RANDOM}) group by 1, 2)"
_FIRES = f"{_THR}, {_TEST}, fires as (select model, build, cond_id, count(*) windows, count(*) filter (mean < threshold) fired, round(avg((mean < threshold)::int), 9) rate from tested join thr using (model, build) group by 1, 2, 3)"
ORACLE = {
    "win_consecutive": duck("select * from tested", "outcomes", more=_TEST),
    "win_random": duck(_RANDOM, "outcomes", more=_TUNE, conds=["clean"]),
    "alarm_threshold": duck("select * from thr", "outcomes", more=_THR, conds=["clean"]),
    "alarm_fires": duck("select * from fires", "outcomes", more=_FIRES),
    "alarm_judge": duck("select *, case when hits >= 0.90::double * harmful_windows and clean_fires <= 2 then 'PASS' else 'FAIL' end verdict from (select model, build, sum(fired) filter (cond_id in ('demo/fade/5', 'demo/jitter/5'))::bigint hits, sum(windows) filter (cond_id in ('demo/fade/5', 'demo/jitter/5'))::bigint harmful_windows, sum(fired) filter (cond_id = 'clean')::bigint clean_fires from fires group by 1, 2)", "outcomes", more=_FIRES),
}
