"""Column quantisation analytics over array<float> features (here `embeddings`): ranges, levels, error ratios.

A row of an array is an item, an array index a channel; the calibration rows are those with vec_id % 4 = 0.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.fixtures import table
from plumbline.operators.metrics import r9
from plumbline.operators.ordered import percentiles
from plumbline.shared import written

LEVELS = 255


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def long(df: DataFrame) -> DataFrame:
    return df.select("item", F.posexplode("v").alias("channel", "x"))


def calibration(df: DataFrame) -> DataFrame:
    return df.filter("item % 4 = 0")


def q_range_minmax(df: DataFrame) -> DataFrame:
    return long(calibration(df)).groupBy("channel").agg(r9(F.min("x")).alias("lo"), r9(F.max("x")).alias("hi"))


def q_range_percentile(df: DataFrame, p: float = 0.9999) -> DataFrame:
    """Symmetric range at a percentile of |x|, clipped to the least and most seen."""
    rows = long(calibration(df))
    own = rows.groupBy("channel").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    own = own.join(percentiles(rows.withColumn("x", F.abs("x")), ["channel"], "x", [p]), "channel").withColumn("t", F.col("p")[0])
    return own.select("channel", r9(F.greatest(F.col("a"), -F.col("t"))).alias("lo"), r9(F.least(F.col("b"), F.col("t"))).alias("hi"))


def q_range_entropy(df: DataFrame, bins: int = 128) -> DataFrame:
    """The range of |x| that loses least information (Kullback-Leibler) when its histogram is reduced to `bins` / 4 levels.

    A range of `width` bins puts what lies beyond into its last bin; a level spreads its count evenly over the bins of
    it that are not empty. All widths are tried at once, over histograms of at most `bins` rows a channel.
    """
    spark, levels = df.sparkSession, bins // 4
    own = long(calibration(df)).select("channel", F.abs("x").alias("a"))
    top = written(spark, own.groupBy("channel").agg(F.max("a").alias("top")), "tops")
    place = F.coalesce(F.least(F.lit(bins - 1), F.floor(F.col("a") / F.nullif("top", F.lit(0.0)) * bins)), F.lit(0)).cast("int")
    hist = own.join(top, "channel").groupBy("channel", "top", place.alias("bin")).agg(F.count("*").alias("n"))
    tried = hist.withColumn("width", F.explode(F.sequence(F.lit(levels), F.lit(bins)))).withColumn("bin", F.least("bin", F.col("width") - 1))
    p = tried.groupBy("channel", "top", "width", "bin").agg(F.sum("n").cast("double").alias("p"))
    level = F.floor(F.col("bin") * levels / F.col("width"))
    held = p.groupBy("channel", "top", "width", level.alias("level")).agg(F.sum("p").alias("p"), F.count("*").alias("used"), F.sum(F.col("p") * F.log("p")).alias("plogp"))
    loss = held.groupBy("channel", "top", "width").agg(r9(F.sum(F.col("plogp") - F.col("p") * F.log(F.col("p") / F.col("used"))) / F.sum("p")).alias("kl"))
    best = loss.groupBy("channel", "top").agg(F.min(F.struct("kl", "width")).alias("b"))
    return best.select("channel", r9(F.col("top") * F.col("b.width") / bins).alias("limit"))


def with_scale(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values with the scale and zero point of their channel's range (widened to hold 0)."""
    lo, hi = F.least(F.col("lo"), F.lit(0.0)), F.greatest(F.col("hi"), F.lit(0.0))
    scale = F.when(hi > lo, (hi - lo) / LEVELS).otherwise(1.0)
    own = ranges.select("channel", scale.alias("scale"), F.rint(-lo / scale).alias("zero"))
    return long(df).join(written(df.sparkSession, own, "ranges"), "channel")  # a row a channel


def level(x: Column) -> Column:
    """Divide, round half to even, add the zero point, clip."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(LEVELS)), F.rint(x / F.col("scale")) + F.col("zero")))


def restored() -> Column:
    return (level(F.col("x")) - F.col("zero")) * F.col("scale")


def quantised(df: DataFrame) -> DataFrame:
    return with_scale(df, q_range_minmax(df)).withColumns({"level": level(F.col("x")).cast("int"), "y": restored()})


def decibel(signal: Column, noise: Column) -> Column:
    eps = 2.220446049250313e-16
    return 20 * F.log10(F.greatest(F.sqrt(signal), F.lit(eps)) / F.greatest(F.sqrt(noise), F.lit(eps)))


def q_sqnr(q: DataFrame, keys: list[str]) -> DataFrame:
    return q.groupBy(*keys).agg(F.round(decibel(F.sum(F.col("x") ** 2), F.sum((F.col("x") - F.col("y")) ** 2)), 6).alias("sqnr_db"))


def tensors(df: DataFrame, parts: int = 8) -> DataFrame:
    """Channels in groups that stand for tensors in order, clean and with a damaged copy (darkened by half)."""
    q = quantised(df)
    scaled = q.withColumns({"x": F.col("x") * 0.25}).withColumn("y", restored())
    both = q.withColumn("cond", F.lit("clean")).unionByName(scaled.withColumn("cond", F.lit("damaged")))
    width = F.floor(F.col("channel") / 8).cast("int")
    sums = both.groupBy("cond", "item", width.alias("tensor")).agg(F.sum(F.col("x") ** 2).alias("s"), F.sum((F.col("x") - F.col("y")) ** 2).alias("n"))
    return sums.withColumn("db", decibel(F.col("s"), F.col("n")))


def extra_error(t: DataFrame) -> DataFrame:
    """E(t): mean over items of clean minus damaged SQNR; early: the first tenth of the tensors, rounded up."""
    clean = t.filter("cond = 'clean'").select("item", "tensor", F.col("db").alias("a"))
    bad = t.filter("cond = 'damaged'").select("item", "tensor", F.col("db").alias("b"))
    e = clean.join(bad, ["item", "tensor"]).groupBy("tensor").agg(F.round(F.avg(F.col("a") - F.col("b")), 6).alias("e"))
    n = e.agg(F.ceil(F.count("*") * 0.1).alias("k"))  # one row
    return e.crossJoin(F.broadcast(n)).select("tensor", "e", (F.col("tensor") < F.col("k")).alias("early"))


#: How the range of a channel can be found: name -> function of (item, v) rows giving channel, lo, hi. Users add their own.
RANGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "minmax": q_range_minmax,
    "percentile": q_range_percentile,
    "entropy": lambda df: q_range_entropy(df).select("channel", (-F.col("limit")).alias("lo"), F.col("limit").alias("hi")),
}


def channel_ranges(df: DataFrame, how: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """channel, lo, hi by a registered way, or by one's own."""
    return (RANGES[how] if isinstance(how, str) else how)(df).select("channel", "lo", "hi")


def q_ranges(df: DataFrame) -> DataFrame:
    """The ranges of all registered ways, side by side."""
    all_ = [channel_ranges(df, how).withColumn("how", F.lit(how)) for how in ("minmax", "percentile", "entropy")]
    return reduce(DataFrame.unionByName, all_)


def first_ones(df: DataFrame, order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows with their places: each task keeps its own k, and these are merged; k is small."""
    first = df.orderBy(*order).limit(k).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"))
    return first.select(F.posexplode("_rows").alias("_at", "_row")).select((F.col("_at") + 1).cast("int").alias(place), "_row.*")


def q_divergence(t: DataFrame, low: float = 10.0) -> DataFrame:
    """Per condition: first tensor below `low` dB, largest single drop, median over tensors of the mean SQNR."""
    mean = t.groupBy("cond", "tensor").agg(F.round(F.avg("db"), 6).alias("db"))
    own = mean.withColumn("drop", F.col("db") - F.lag("db").over(Window.partitionBy("cond").orderBy("tensor")))  # a row a tensor
    return own.groupBy("cond").agg(F.min(F.when(F.col("db") < low, F.col("tensor"))).alias("first_low"), F.round(F.min("drop"), 5).alias("largest_drop"), F.round(F.median("db"), 5).alias("median_db"))


QUERIES = {
    "q_range_minmax": lambda s, d: q_range_minmax(vectors(s, d)),
    "q_range_percentile": lambda s, d: q_range_percentile(vectors(s, d)),
    "q_range_entropy": lambda s, d: q_range_entropy(vectors(s, d)),
    "q_ranges": lambda s, d: q_ranges(vectors(s, d)),
    "q_fake_quantize": lambda s, d: quantised(vectors(s, d)).select("item", "channel", r9(F.col("y")).alias("y")),
    "q_levels": lambda s, d: quantised(vectors(s, d)).select("item", "channel", "level"),
    "q_distinct_levels": lambda s, d: quantised(vectors(s, d)).groupBy("item").agg(F.count_distinct("level").alias("distinct_levels")),
    "q_level_ratio": lambda s, d: quantised(vectors(s, d)).groupBy("channel").agg(F.count_distinct("level").alias("levels"), F.count_distinct("x").alias("inputs")).agg(r9(F.avg(F.col("levels") / F.least(F.col("inputs"), F.lit(256)))).alias("ratio")),
    "q_sqnr": lambda s, d: q_sqnr(quantised(vectors(s, d)), ["item"]),
    "q_sqnr_pooled": lambda s, d: q_sqnr(quantised(vectors(s, d)), []),
    "q_local_vs_total": lambda s, d: tensors(vectors(s, d)).filter("cond = 'clean'").withColumns({"ts": F.sum("s").over(Window.partitionBy("item").orderBy("tensor")), "tn": F.sum("n").over(Window.partitionBy("item").orderBy("tensor"))}).select("item", "tensor", F.round("db", 5).alias("local_db"), F.round(decibel(F.col("ts"), F.col("tn")), 5).alias("total_db")),
    "q_divergence": lambda s, d: q_divergence(tensors(vectors(s, d))),
    "q_extra_error": lambda s, d: extra_error(tensors(vectors(s, d))).groupBy("early").agg(F.count("*").alias("tensors"), F.round(F.median("e"), 5).alias("median_e")),
    "q_top_tensors": lambda s, d: first_ones(extra_error(tensors(vectors(s, d))), [F.desc("e"), F.asc("tensor")], 5).select("place", "tensor", F.round("e", 5).alias("e"), "early"),
}
_L = "with l as materialized (select vec_id item, unnest(range(0, len(embedding)))::int channel, unnest(embedding)::double x from embeddings), r as (select channel, round(min(x), 9) lo, round(max(x), 9) hi from l where item % 4 = 0 group by 1)"
_QS = f"""{_L}, sc as (select channel, scale, round_even(-lo / scale, 0) as zero from (select channel, lo, case when hi > lo then (hi - lo) / 255 else 1.0::double end scale from (select channel, least(lo, 0) lo, greatest(hi, 0) hi from r))),
q as materialized (select *, (lv - zero) * scale y from (select item, channel, x, scale, zero, greatest(0, least(255, round_even(x / scale, 0) + zero)) lv from l join sc using (channel)))"""


def _db(s: str, n: str) -> str:
    return f"20 * log10(greatest(sqrt({s}), 2.220446049250313e-16::double) / greatest(sqrt({n}), 2.220446049250313e-16::double))"


_TN = f"""{_QS}, b as (select 'clean' cond, item, channel, x, y from q union all select 'damaged', item, channel, x * 0.25::double, (greatest(0, least(255, round_even(x * 0.25::double / scale, 0) + zero)) - zero) * scale from q),
t as materialized (select cond, item, channel // 8 tensor, sum(x * x) s, sum((x - y) * (x - y)) n, {_db('sum(x * x)', 'sum((x - y) * (x - y))')} db from b group by 1, 2, 3)"""
_E = f"{_TN}, e as (select a.tensor, round(avg(a.db - c.db), 6) e from t a join t c using (item, tensor) where a.cond = 'clean' and c.cond = 'damaged' group by 1), ee as (select tensor, e, tensor < ceil(count(*) over () * 0.1::double) early from e)"
ORACLE = {
    "q_range_minmax": f"{_L} select * from r",
    "q_range_percentile": f"{_L} select channel, round(greatest(min(x), -quantile_cont(abs(x), 0.9999::double)), 9) lo, round(least(max(x), quantile_cont(abs(x), 0.9999::double)), 9) hi from l where item % 4 = 0 group by 1",
    "q_range_entropy": f"""{_L}, a as (select channel, abs(x) a, max(abs(x)) over (partition by channel) top from l where item % 4 = 0),
h as (select channel, top, coalesce(least(127, floor(a / nullif(top, 0) * 128)), 0)::int bin, count(*) n from a group by all),
p as (select channel, top, width, least(bin, width - 1) bin, sum(n)::double p from h cross join range(32, 129) w(width) group by all),
g as (select channel, top, width, bin * 32 // width as level, sum(p) p, count(*) used, sum(p * ln(p)) plogp from p group by all),
k as (select channel, top, width, round(sum(plogp - p * ln(p / used)) / sum(p), 9) kl from g group by all)
select channel, round(top * width / 128.0::double, 9) as "limit" from (select *, row_number() over (partition by channel order by kl, width) rn from k) where rn = 1""",
    "q_fake_quantize": f"{_QS} select item, channel, round(y, 9) y from q",
    "q_levels": f"{_QS} select item, channel, lv::int as level from q",
    "q_distinct_levels": f"{_QS} select item, count(distinct lv) distinct_levels from q group by 1",
    "q_level_ratio": f"{_QS} select round(avg(a / least(b, 256)::double), 9) ratio from (select channel, count(distinct lv) a, count(distinct x) b from q group by 1)",
    "q_sqnr": f"{_QS} select item, round({_db('sum(x * x)', 'sum((x - y) * (x - y))')}, 6) sqnr_db from q group by 1",
    "q_sqnr_pooled": f"{_QS} select round({_db('sum(x * x)', 'sum((x - y) * (x - y))')}, 6) sqnr_db from q",
    "q_local_vs_total": f"{_TN} select item, tensor, round(db, 5) local_db, round({_db('ts', 'tn')}, 5) total_db from (select *, sum(s) over w ts, sum(n) over w tn from t where cond = 'clean' window w as (partition by item order by tensor))",
    "q_divergence": f"{_TN} select cond, min(tensor) filter (db < 10) first_low, round(min(d), 5) largest_drop, round(median(db), 5) median_db from (select *, db - lag(db) over (partition by cond order by tensor) d from (select cond, tensor, round(avg(db), 6) db from t group by 1, 2)) group by 1",
    "q_extra_error": f"{_E} select early, count(*) tensors, round(median(e), 5) median_e from ee group by 1",
    "q_top_tensors": f"{_E} select place, tensor, round(e, 5) e, early from (select *, row_number() over (order by e desc, tensor) place from ee) where place <= 5",
}
ORACLE["q_ranges"] = f"""select *, 'minmax' how from ({ORACLE['q_range_minmax']}) union all select *, 'percentile' from ({ORACLE['q_range_percentile']})
union all select channel, -"limit", "limit", 'entropy' from ({ORACLE['q_range_entropy']})"""
