"""Seeded splits and plans. Order is md5(item|seed): no draw depends on partitioning or on the engine.

A sample of n takes the n items with the smallest hashes. For a sample that one task could not sort, the n-th hash is
found by counting (see `smallest`), so that no window runs over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.fixtures import CLASSES, duck, items, scores
from plumbline.operators.outcomes import outcomes

SPLITS = {"test": 0.5, "int8_calibration": 0.05, "conformal_calibration": 0.2, "tuning": 0.2}
KINDS = ["fade", "jitter", "fog", "blur"]


def order_key(seed: int | str, item: str = "item") -> Column:
    return F.md5(F.concat_ws("|", F.col(item).cast("string"), F.lit(str(seed))))


def smallest(df: DataFrame, n: int, key: str) -> DataFrame:
    """The rows with the n smallest values of a string key, found by counting prefixes instead of sorting rows."""
    counts = df.groupBy(F.substring(key, 1, 4).alias("_prefix")).agg(F.count("*").alias("_m"))  # 65,536 rows at most
    below = counts.withColumn("_upto", F.sum("_m").over(Window.orderBy("_prefix")))
    below = below.select("_prefix", (F.col("_upto") - F.col("_m")).alias("_before"), "_upto")
    near = df.withColumn("_prefix", F.substring(key, 1, 4)).join(F.broadcast(below), "_prefix").filter(F.col("_before") < n)
    cut = near.filter(F.col("_upto") > n).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_prefix").orderBy(key, "item")))
    return near.filter(F.col("_upto") <= n).drop("_prefix", "_before", "_upto").union(cut.filter(F.col("_rank") <= n).drop("_prefix", "_before", "_upto", "_rank"))


def split_subset(df: DataFrame, n: int | None, seed: int | str = 0) -> DataFrame:
    """n items chosen by hash; all of them if n is null or not below their number."""
    return df.select("item") if n is None else smallest(df.select("item", order_key(seed).alias("_key")), n, "_key").select("item")


def split_exclude(df: DataFrame, n: int, exclude: DataFrame, seed: int | str = 1) -> DataFrame:
    return split_subset(df.join(exclude, "item", "left_anti"), n, seed)


def split_make(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Disjoint splits of the given sizes, one after another from what is left; refuses too few items."""
    if df.count() < sum(sizes.values()):
        raise ValueError("too few items for the splits")
    ordered = df.select("item", order_key("splits").alias("_key"))
    out, upto, taken = None, 0, None
    for name, n in sizes.items():
        upto += n
        own = smallest(ordered, upto, "_key").select("item")
        part = (own if taken is None else own.join(taken, "item", "left_anti")).withColumn("split", F.lit(name))
        out, taken = part if out is None else out.union(part), own
    return out


def split_unassigned(df: DataFrame, splits: DataFrame) -> DataFrame:
    return df.select("item").join(splits, "item", "left_anti")


def split_overlap(splits: DataFrame) -> DataFrame:
    """Items that each pair of splits shares; pairs that share none have 0."""
    names = splits.select("split").distinct()
    pairs = names.select(F.col("split").alias("a")).crossJoin(names.select(F.col("split").alias("b"))).filter("a < b")
    shared = splits.select("item", F.col("split").alias("a")).join(splits.select("item", F.col("split").alias("b")), "item").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def split_sizes(splits: DataFrame, sizes: DataFrame) -> DataFrame:
    got = splits.groupBy("split").agg(F.count("*").alias("n"))
    return sizes.join(got, "split", "left").select("split", "expected", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("ok"))


def split_class_counts(labelled: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Expected, least, median and most items of a class in each split, and classes without any."""
    spark = labelled.sparkSession
    grid = labelled.select("split").distinct().crossJoin(spark.range(classes).select(F.col("id").cast("int").alias("label")))
    counts = labelled.groupBy("split", "label").agg(F.count("*").alias("n"))
    full = grid.join(counts, ["split", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.groupBy("split").agg((F.sum("n") / classes).alias("expected"), F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("empty"))


def ranked(df: DataFrame, seed: int | str) -> DataFrame:
    """item and rn, its place in the seeded order. Places are counted in two steps: within prefixes, then before them."""
    own = df.select("item", order_key(seed).alias("_key")).withColumn("_prefix", F.substring("_key", 1, 3))
    counts = own.groupBy("_prefix").agg(F.count("*").alias("_m"))
    before = counts.select("_prefix", (F.sum("_m").over(Window.orderBy("_prefix")) - F.col("_m")).alias("_before"))  # 4,096 rows
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy("_key", "item"))
    return own.join(F.broadcast(before), "_prefix").select("item", (F.col("_before") + place).cast("long").alias("rn"))


def plan_balanced(df: DataFrame, kinds: list[str] = KINDS, clean: float = 1 / 3, seed: int = 9) -> DataFrame:
    """Which version of each item: a share stays clean, the k-th other gets pair k mod (kinds * 5)."""
    n, m = df.count(), len(kinds) * 5
    n_clean = round(n * clean)
    pair = F.pmod(F.col("rn") - 1 - n_clean, F.lit(m))
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.floor(pair / 5) + 1).cast("int"))
    damaged = F.col("rn") > n_clean
    return ranked(df, seed).select("item", F.when(damaged, kind).alias("corruption"), F.when(damaged, pair % 5 + 1).otherwise(0).cast("int").alias("severity"))


def plan_random_half(df: DataFrame, kinds: list[str] = KINDS, seed: int = 5) -> DataFrame:
    """Half of the items (rounded down) damaged, kind and severity from salts of their own."""
    half = df.count() // 2

    def draw(salt: str, n: int) -> Column:
        return (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("item").cast("string"), F.lit(str(seed)), F.lit(salt))), 1, 8), 16, 10).cast("long") % n + 1).cast("int")

    damaged = F.col("rn") <= half
    return ranked(df, seed).select("item", F.when(damaged, F.element_at(F.array(*map(F.lit, kinds)), draw("kind", len(kinds)))).alias("corruption"), F.when(damaged, draw("severity", 5)).otherwise(0).alias("severity"))


def plan_apply(scored: DataFrame, plan: DataFrame) -> DataFrame:
    """Each item's row from the condition that its plan names."""
    return scored.join(plan, ["item", "cond_id"])


def items_same(scored: DataFrame, reference: str = "clean") -> DataFrame:
    """Each cell's number of items and content hash against the reference cell of its model and build."""
    sums = scored.groupBy("model", "build", "cond_id").agg(
        F.count("*").alias("n"), F.min("item").alias("first"), F.max("item").alias("last"), F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", "item", "label")), 1, 8), 16, 10).cast("long")).alias("content")
    )
    ref = sums.filter(F.col("cond_id") == reference).select("model", "build", F.struct("n", "first", "last", "content").alias("want"))
    return sums.join(ref, ["model", "build"], "left").select("model", "build", "cond_id", "n", "first", "last", "content", F.coalesce(F.struct("n", "first", "last", "content") == F.col("want"), F.lit(False)).alias("same"))


def items_missing_cells(grid: DataFrame, scored: DataFrame) -> DataFrame:
    have = scored.select("model", "build", "cond_id").distinct()
    return grid.join(have, ["model", "build", "cond_id"], "left_anti").groupBy("model", "build").agg(F.array_join(F.array_sort(F.collect_list("cond_id")), ",").alias("missing"))


def all_items(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item")


def _sizes(df: DataFrame) -> dict[str, int]:
    n = df.count()
    return {k: int(n * v) for k, v in SPLITS.items()}


def q_split_make(spark: SparkSession, sf: str) -> DataFrame:
    own = all_items(spark, sf)
    return split_make(own, _sizes(own))


def q_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _sizes(all_items(spark, sf))
    return split_sizes(q_split_make(spark, sf), spark.createDataFrame(list(sizes.items()), "split string, expected long"))


def q_plan_apply(spark: SparkSession, sf: str) -> DataFrame:
    plan = plan_balanced(all_items(spark, sf), ["fade", "jitter"]).select("item", F.when(F.col("severity") == 0, "clean").otherwise(F.concat_ws("/", F.lit("demo"), "corruption", "severity")).alias("cond_id"))
    mixed = plan_apply(outcomes(scores(spark, sf)), plan)
    return mixed.groupBy("build", "cond_id").agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("hits"))


def q_items_missing(spark: SparkSession, sf: str) -> DataFrame:
    from plumbline.fixtures import cells

    have = scores(spark, sf, conds=["clean", "demo/fade/1", "demo/fade/5"])
    return items_missing_cells(cells(spark).drop("boost"), have)


def _kinds(k: list[str], at: str) -> str:
    return f"([{', '.join(map(repr, k))}])[{at}]"


_ALL = "allitems as materialized (select o_orderkey::bigint item from orders)"
_ORDER = "ordered as (select item, row_number() over (order by md5(item || '|splits'), item) rn, count(*) over () n from allitems)"
_MAKE = f"{_ALL}, {_ORDER}, made as materialized (select item, case when rn <= n1 then 'test' when rn <= n1 + n2 then 'int8_calibration' when rn <= n1 + n2 + n3 then 'conformal_calibration' when rn <= n1 + n2 + n3 + n4 then 'tuning' end split from (select *, floor(n * 0.5::double)::bigint n1, floor(n * 0.05::double)::bigint n2, floor(n * 0.2::double)::bigint n3, floor(n * 0.2::double)::bigint n4 from ordered))"


def _balanced(kinds: list[str]) -> str:
    m = len(kinds) * 5
    return f"balanced as (select item, case when rn > nc then {_kinds(kinds, f'((rn - 1 - nc) % {m}) // 5 + 1')} end corruption, case when rn > nc then (rn - 1 - nc) % {m} % 5 + 1 else 0 end::int severity from (select *, round_even(n * (1.0::double / 3), 0)::bigint nc from (select item, row_number() over (order by md5(item || '|9'), item) rn, count(*) over () n from allitems)))"


QUERIES = {
    "split_subset": lambda spark, sf: split_subset(all_items(spark, sf), 500),
    "split_exclude": lambda spark, sf: split_exclude(all_items(spark, sf), 300, split_subset(all_items(spark, sf), 500)),
    "split_make": q_split_make,
    "split_unassigned": lambda spark, sf: split_unassigned(all_items(spark, sf), q_split_make(spark, sf)),
    "split_overlap": lambda spark, sf: split_overlap(q_split_make(spark, sf)),
    "split_sizes": q_split_sizes,
    "split_class_counts": lambda spark, sf: split_class_counts(items(spark, sf)),
    "plan_balanced": lambda spark, sf: plan_balanced(all_items(spark, sf)),
    "plan_random_half": lambda spark, sf: plan_random_half(all_items(spark, sf)),
    "plan_apply": q_plan_apply,
    "items_same": lambda spark, sf: items_same(scores(spark, sf)),
    "items_missing_cells": q_items_missing,
}
ORACLE = {
    "split_subset": f"with {_ALL} select item from allitems order by md5(item || '|0'), item limit 500",
    "split_exclude": f"with {_ALL}, s as (select item from allitems order by md5(item || '|0'), item limit 500) select item from allitems where item not in (select item from s) order by md5(item || '|1'), item limit 300",
    "split_make": f"with {_MAKE} select item, split from made where split is not null",
    "split_unassigned": f"with {_MAKE} select item from made where split is null",
    "split_overlap": f"with {_MAKE} select a.split a, b.split b, 0::bigint shared from (select distinct split from made where split is not null) a, (select distinct split from made where split is not null) b where a.split < b.split",
    "split_sizes": f"with {_MAKE} select split, count(*) expected, count(*) n, true ok from made where split is not null group by 1",
    "split_class_counts": duck("select split, sum(n) / 10.0::double expected, min(n) least, median(n) median, max(n) most, count(*) filter (n = 0) empty from (select s.split, l.label, count(i.item) n from (select distinct split from items) s cross join range(0, 10) l(label) left join items i on i.split = s.split and i.label = l.label group by all) group by 1", "items"),
    "plan_balanced": f"with {_ALL}, {_balanced(KINDS)} select * from balanced",
    "plan_random_half": f"with {_ALL}, o as (select item, row_number() over (order by md5(item || '|5'), item) rn, count(*) over () n from allitems) select item, case when rn <= n // 2 then {_kinds(KINDS, "('0x' || substr(md5(item || '|5|kind'), 1, 8))::bigint % 4 + 1")} end corruption, case when rn <= n // 2 then ('0x' || substr(md5(item || '|5|severity'), 1, 8))::bigint % 5 + 1 else 0 end::int severity from o",
    "plan_apply": duck("select build, o.cond_id, count(*) n, sum(correct)::bigint hits from outcomes o join (select item, case when severity = 0 then 'clean' else 'demo/' || corruption || '/' || severity end cond_id from balanced) p on o.item = p.item and o.cond_id = p.cond_id group by 1, 2", "outcomes", more=f"{_ALL}, {_balanced(['fade', 'jitter'])}"),
    "items_same": duck("select model, build, cond_id, count(*) n, min(item) as first, max(item) as last, sum(('0x' || substr(md5(item || '|' || label), 1, 8))::bigint)::bigint content, true same from scores group by 1, 2, 3", "scores"),
    "items_missing_cells": "select 'm0' model, build, 'demo/fade/3,demo/jitter/3,demo/jitter/5' missing from (values ('ref'), ('small')) t(build) where exists (select 1 from orders)",
}
