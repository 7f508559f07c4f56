"""Conditions: the grid, names and ids, deterministic damage of numeric arrays, and scoring of every variant.

Damage is a registry of name -> (array, severity, item) -> array; patterns come from hashes of (item, place), so
severity changes strength, never pattern, and recomputing a variant gives the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixtures import table
from plumbline.operators.splits import _ALL, KINDS, _balanced, all_items, plan_balanced

GRID = [("clean", None, 0)] + [(k, "demo", s) for k in ("darken", "blend", "noise", "blur") for s in (1, 3, 5)]


def unit(item: Column, i: Column, salt: str) -> Column:
    """A number in (0, 1) hashed from an item and a place."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", item.cast("string"), i.cast("string"), F.lit(salt))), 1, 6), 16, 10).cast("double") + 0.5) / 16777216.0


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def darken(v: Column, severity: Column, item: Column) -> Column:
    """Decode gamma, halve the light `severity` times, encode."""
    return F.transform(v, lambda x: F.pow(F.pow(x, F.lit(2.2)) * F.pow(F.lit(2.0), -severity), F.lit(1 / 2.2)))


def blend(v: Column, severity: Column, item: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        d = clip(0.15 * severity + 0.1 * (unit(item, i, "fog") - 0.5))
        return x * (1 - d) + 0.85 * d

    return F.transform(v, one)


def noise(v: Column, severity: Column, item: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        g = F.sqrt(-2 * F.log(unit(item, i, "n1"))) * F.cos(2 * 3.141592653589793 * unit(item, i, "n2"))
        return clip(x + 0.04 * severity * g)

    return F.transform(v, one)


def blur(v: Column, severity: Column, item: Column) -> Column:
    """A moving average of radius `severity`, places beyond the ends mirrored."""
    n = F.size(v)

    def one(x: Column, i: Column) -> Column:
        def near(k: Column) -> Column:
            around = F.greatest(F.lit(1), 2 * n - 2)
            j = F.pmod(i + k, around)
            return F.element_at(v, F.when(j >= n, around - j).otherwise(j) + 1)

        return F.aggregate(F.sequence(-severity, severity), F.lit(0.0), lambda a, k: a + near(k)) / (2 * severity + 1)

    return F.transform(v, one)


REGISTRY: dict[str, Callable[[Column, Column, Column], Column]] = {"darken": darken, "blend": blend, "noise": noise, "blur": blur}


def cond_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRID, "corruption string, suite string, severity int")


def cond_label(df: DataFrame) -> Column:
    """clean, or the kind, its suite and the severity; null: no images (speed)."""
    return F.when(F.col("corruption").isNull(), "no images (speed)").when(F.col("corruption") == "clean", "clean").otherwise(F.concat(F.translate("corruption", "_", " "), F.lit(" ("), F.initcap("suite"), F.lit(") s"), F.col("severity").cast("string")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def cond_fanout(df: DataFrame, grid: DataFrame, registry: dict = REGISTRY) -> DataFrame:
    """Every item (item, v in [0, 1]) under every condition of a small grid; severity 0 is the untouched copy."""
    rows = df.crossJoin(F.broadcast(grid))
    out = F.when(F.col("severity") == 0, F.col("v"))
    for name, f in registry.items():
        out = out.when(F.col("corruption") == name, f(F.col("v"), F.col("severity"), F.col("item")))
    return rows.withColumn("v", out)


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") * 2 + 0.5))).alias("v"))


def class_weights(dim: int = 64, classes: int = 10) -> list[list[float]]:
    """A fixed linear scorer: weights hashed from class and place."""
    import hashlib

    return [[int(hashlib.md5(f"{c}|{j}".encode()).hexdigest()[:4], 16) / 32768 - 1 for j in range(dim)] for c in range(classes)]


def score_batch(variants: DataFrame, weights: list[list[float]], steps: int = 8) -> DataFrame:
    """Scores of both builds in one projection: full weights, and weights in whole 1 / steps."""
    builds = {"ref": weights, "small": [[round(x * steps) / steps for x in row] for row in weights]}

    def scores(rows: list[list[float]]) -> Column:
        return F.array(*[F.aggregate(F.zip_with("v", F.array(*map(F.lit, row)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) for row in rows])

    both = F.explode(F.array(*[F.struct(F.lit(b).alias("build"), scores(rows).alias("z")) for b, rows in builds.items()]))
    return variants.withColumn("_s", both).select("item", "corruption", "severity", "_s.build", "_s.z")


def _sum(v: str = "v") -> Column:
    return F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)


def one_kind(kind: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return cond_fanout(pictures(spark, sf), cond_grid(spark).filter(F.col("corruption") == kind)).select("item", "severity", _sum().alias("total"), F.round(F.element_at("v", 7), 9).alias("seventh"))

    return run


def q_slug(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat_ws("--", slug(F.col("p_brand")), slug(F.col("p_name"))).alias("model_id"), F.concat_ws("--", slug(F.col("p_name")), F.lit("int8"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 12)).alias("build_id"))


def q_label(spark: SparkSession, sf: str) -> DataFrame:
    """The label of every item's condition in a plan; every tenth clean item has none (speed only)."""
    plan = plan_balanced(all_items(spark, sf))
    kind = F.when(F.col("severity") > 0, F.col("corruption")).when(F.col("item") % 10 != 9, "clean")
    rows = plan.select("item", kind.alias("corruption"), F.when(F.col("severity") > 0, "demo").alias("suite"), "severity")
    return rows.select("item", cond_label(rows).alias("label"))


def q_score(spark: SparkSession, sf: str) -> DataFrame:
    grid = cond_grid(spark).filter("severity in (0, 5) and corruption in ('clean', 'darken')")
    z = score_batch(cond_fanout(pictures(spark, sf), grid, {"darken": darken}), class_weights())
    return z.select("item", "corruption", "build", F.round(F.array_max("z"), 6).alias("best"), F.round(F.element_at("z", 3), 6).alias("third"))


QUERIES = {
    "cond_grid": lambda s, d: all_items(s, d).crossJoin(F.broadcast(cond_grid(s))),  # the cells to score
    "cond_label": q_label,
    "ids_slug": q_slug,
    "cond_fanout": lambda s, d: cond_fanout(pictures(s, d), cond_grid(s)).groupBy("corruption", "severity").agg(F.count("*").alias("n"), F.round(F.sum(_sum()), 3).alias("total")),
    **{f"cond_{k}": one_kind(k) for k in REGISTRY},
    "score_batch": q_score,
}
_GRID = "grid(corruption, suite, severity) as (values " + ", ".join(f"('{k}', {'null' if s is None else repr(s)}, {n})" for k, s, n in GRID) + ")"
_PIC = "pic as materialized (select vec_id item, list_transform(embedding, lambda x: greatest(0.0::double, least(1.0::double, x::double * 2 + 0.5::double))) v from embeddings)"


def _u(salt: str) -> str:
    return f"((('0x' || substr(md5(item || '|' || (i - 1) || '|{salt}'), 1, 6))::bigint::double + 0.5::double) / 16777216.0::double)"


_D = f"greatest(0.0::double, least(1.0::double, 0.15::double * severity + 0.1::double * ({_u('fog')} - 0.5::double)))"
_KIND = {
    "darken": "list_transform(v, lambda x: pow(pow(x, 2.2::double) * pow(2.0::double, -severity), 1 / 2.2::double))",
    "blend": f"list_transform(v, lambda x, i: x * (1 - {_D}) + 0.85::double * {_D})",
    "noise": f"list_transform(v, lambda x, i: greatest(0.0::double, least(1.0::double, x + 0.04::double * severity * (sqrt(-2 * ln({_u('n1')})) * cos(2 * 3.141592653589793::double * {_u('n2')})))))",
    "blur": "list_transform(v, lambda x, i: list_sum(list_transform(range(-severity, severity + 1), lambda k: v[case when i - 1 + k < 0 then -(i - 1 + k) when i - 1 + k >= len(v) then 2 * len(v) - 2 - (i - 1 + k) else i - 1 + k end + 1])) / (2 * severity + 1))",
}
_FAN = "fan as materialized (select item, corruption, severity, case corruption when 'clean' then v " + " ".join(f"when '{k}' then {e}" for k, e in _KIND.items()) + " end v from pic cross join grid)"


def _weights_sql(steps: int | None) -> str:
    rows = class_weights()
    rows = rows if steps is None else [[round(x * steps) / steps for x in r] for r in rows]
    return "[" + ", ".join("[" + ", ".join(f"{x!r}::double" for x in r) + "]" for r in rows) + "]"


ORACLE = {
    "cond_grid": f"with {_GRID}, {_ALL} select item, corruption, suite, severity from allitems cross join grid",
    "cond_label": f"with {_ALL}, {_balanced(KINDS)} select item, case when severity > 0 then replace(corruption, '_', ' ') || ' (Demo) s' || severity when item % 10 <> 9 then 'clean' else 'no images (speed)' end as label from balanced",
    "ids_slug": "select p_partkey, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '--' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') model_id, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '--int8--' || substr(sha256(p_partkey::varchar), 1, 12) build_id from part",
    "cond_fanout": f"with {_GRID}, {_PIC}, {_FAN} select corruption, severity, count(*) n, round(sum(round(list_sum(v), 6)), 3) total from fan group by 1, 2",
    **{f"cond_{k}": f"with {_GRID}, {_PIC}, {_FAN} select item, severity, round(list_sum(v), 6) total, round(v[7], 9) seventh from fan where corruption = '{k}'" for k in _KIND},
    "score_batch": f"with {_GRID}, {_PIC}, {_FAN}, w(build, w) as (values ('ref', {_weights_sql(None)}), ('small', {_weights_sql(8)})), z as (select item, corruption, build, list_transform(w, lambda r: list_sum(list_transform(v, lambda x, i: x * r[i]))) z from fan cross join w where corruption in ('clean', 'darken') and severity in (0, 5)) select item, corruption, build, round(list_max(z), 6) best, round(z[3], 6) third from z",
}
