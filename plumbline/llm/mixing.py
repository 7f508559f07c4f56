"""Mixing sources to target weights by Poisson replication (operator 9).

A source with n of N documents and target weight w gets the mean repetition rate r = N * w / (n * sum of weights), so
that the mixture has about N documents in the wanted shares. A rate is dealt into parts of a mean of `MEAN` at most: a
sum of independent Poisson numbers is Poisson, so a document is repeated as often as the inverse Poisson distribution of
the part's mean says at uniform numbers hashed from (seed, id, part), added up. Distribution functions thus have a
bounded length however rare a source is. Every copy is a row, dealt out and ordered by a hash of (seed, id, copy): a
global shuffle without a sampling pass.

Documents of rare sources with more parts than `BLOCK` are dealt out in blocks of parts before they are repeated, so
that no task makes all the copies of one.

Rates are counted over all documents. Their table has a row for each source; it is written, so that Spark knows its
size and broadcasts it only below its own limit (else it is joined by a shuffle that can split a hot source).

Cases: a null source is a source of its own; a null id hashes as the empty string; repeated rows are drawn alike; null
and empty texts are documents like others, and long ones too; an empty table gives an empty table; sources without a
weight, or with weight 0, give no rows; a weight for a source that does not occur has no effect on the others' shares;
other columns pass through and `copy` (unique for an id, from 1, with gaps between parts) and `shuffle_key` replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, written

SEED = 7
#: Mean of a part, at most; copies of a part stay below COPIES.
MEAN, COPIES = 32, 256
#: Parts that one row is repeated for in one task.
BLOCK = 1000


def uniform(*parts: str, seed: int) -> str:
    """SQL for a number in [0, 1) hashed from the parts and the seed: 52 bits of MD5."""
    text = ", ".join([f"'{seed}'", *(f"coalesce(cast({p} as string), '')" for p in parts)])
    return f"cast(conv(substr(md5(concat_ws('|', {text})), 1, 13), 16, 10) as double) / 4503599627370496D"


def rates(df: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source") -> DataFrame:
    """_source, rate, parts and the Poisson distribution function of a part at 0, 1, 2, ... as an array (MEAN + 12 deviations
    and 20, at most); weights: None for equal ones."""
    spark = df.sparkSession
    counts = written(spark, df.groupBy(F.col(f"`{source}`").alias("_source")).agg(F.count("*").cast("double").alias("n")), "sources")
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        wanted = spark.createDataFrame(list(weights.items()), "_name string, w double")
        weighted = counts.join(wanted, counts._source.cast("string").eqNullSafe(wanted._name)).filter("w > 0").drop("_name")
    all_n, all_w = counts.agg(F.sum("n")).first()[0] or 0.0, weighted.agg(F.sum("w")).first()[0] or 1.0  # two numbers
    rate = weighted.select("_source", (F.lit(float(all_n)) * F.col("w") / (F.col("n") * F.lit(float(all_w)))).alias("rate"))
    rate = rate.selectExpr("_source", "rate", f"cast(ceil(rate / {MEAN}) as bigint) as parts").withColumn("mean", F.col("rate") / F.col("parts"))
    steps = rate.withColumn("k", F.explode(F.expr("sequence(0, cast(ceil(mean + 12 * sqrt(mean) + 20) as int))")))
    upto = "over (partition by _source order by k)"
    steps = steps.selectExpr("_source", "rate", "parts", "mean", "k", f"sum(if(k = 0, 0D, ln(cast(k as double)))) {upto} as ln_factorial")
    steps = steps.selectExpr("_source", "rate", "parts", "k", f"sum(exp(k * ln(mean) - mean - ln_factorial)) {upto} as upto")
    return steps.groupBy("_source", "rate", "parts").agg(F.expr("transform(array_sort(collect_list(struct(k, upto))), x -> x.upto)").alias("upto"))


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, id: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mixture: df's columns, `copy` and `shuffle_key`, in the shuffled order."""
    rate = written(df.sparkSession, rates(df.select(F.col(f"`{source}`")), weights, source), "rates").select("_source", "parts", "upto")
    rest = [c for c in df.columns if c not in ("copy", "shuffle_key")]
    own = df.select(*[F.col(f"`{c}`") for c in rest])
    rated = lambda r: own.join(r, F.col(f"`{source}`").eqNullSafe(F.col("_source")))
    dealt = rated(rate.filter(f"parts <= {BLOCK}")).withColumn("_block", F.lit(0).cast("long"))
    if rate.filter(f"parts > {BLOCK}").count():  # few documents, each with very many copies
        rare = rated(rate.filter(f"parts > {BLOCK}")).withColumn("_block", F.explode(F.expr(f"sequence(0L, (parts - 1) div {BLOCK})")))
        dealt = dealt.unionByName(rare.repartition(F.xxhash64(f"`{id}`", "_block")))
    drawn = f"element_at(transform(array({uniform(f'`{id}`', 'p', seed=seed)}), u -> size(filter(upto, x -> x <= u))), 1)"  # u once a part
    parts = f"transform(sequence(_block * {BLOCK}, least(parts, (_block + 1) * {BLOCK}) - 1), p -> slice(sequence(p * {COPIES} + 1, (p + 1) * {COPIES} - 1), 1, {drawn}))"
    copies = dealt.withColumn("copy", F.explode(F.expr(f"flatten({parts})")))
    copies = copies.withColumn("shuffle_key", F.expr(f"md5(concat_ws('|', '{seed}', coalesce(cast(`{id}` as string), ''), cast(copy as string)))"))
    return copies.select(*[F.col(f"`{c}`") for c in rest], "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


QUERIES = {"op9_mixing": op9_mixing}
ORACLE = {
    "op9_mixing": f"""
with n as (select source, count(*)::double n from documents group by 1),
r as (select source, (select sum(n) from n) / (n * (select count(*) from n)) rate from n),
p as (select source, ceil(rate / {MEAN})::bigint parts, rate / ceil(rate / {MEAN}) mean from r),
k as (select source, parts, mean, unnest(range(0, cast(ceil(mean + 12 * sqrt(mean) + 20) as int) + 1)) k from p),
f as (select *, sum(case when k = 0 then 0 else ln(k::double) end) over (partition by source order by k) lf from k),
c as (select source, k, sum(exp(k * ln(mean) - mean - lf)) over (partition by source order by k) upto from f),
j as (select d.doc_id, d.source, d.text, unnest(range(0, parts)) part from documents d join p on d.source is not distinct from p.source),
u as (select *, cast('0x' || substr(md5('{SEED}|' || coalesce(cast(doc_id as varchar), '') || '|' || part), 1, 13) as bigint) / 4503599627370496.0::double u from j),
d as (select u.doc_id, u.source, u.text, part, count(*) filter (c.upto <= u.u) copies from u join c on u.source is not distinct from c.source group by all),
e as (select doc_id, source, text, unnest(range(part * {COPIES} + 1, part * {COPIES} + copies + 1)) as copy from d)
select doc_id, source, copy, md5('{SEED}|' || coalesce(cast(doc_id as varchar), '') || '|' || copy) as shuffle_key, md5(coalesce(text, '')) as text_md5 from e
"""
}
