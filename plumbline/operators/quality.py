"""Data-quality checks. A check is a name and a SQL predicate that is true where something is wrong; `problems`
gives a row for each broken check of each record. No rows: the data pass. Checks across tables are anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixtures import table
from plumbline.shared import written


def problems(df: DataFrame, keys: list[str], checks: dict[str, str]) -> DataFrame:
    found = F.filter(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(found).alias("problem"))


def missing(df: DataFrame, dimension: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the dimension lacks."""
    return df.join(dimension, on, "left_anti")


# ---- records made from `supplier`: one in every few breaks a rule. The expressions are valid in both engines.

_H = "md5(concat('rec|', cast(s_suppkey as string)))"
RECORD = {
    "id": "s_suppkey",
    "name": "concat('r', cast(s_suppkey % 90 as string))",
    "schema_version": "case when s_suppkey % 7 = 0 then 1 when s_suppkey % 31 = 0 then 3 else 2 end",
    "kind": "case when s_suppkey % 29 = 0 then 'other' when s_suppkey % 5 = 0 then 'accuracy' when s_suppkey % 5 = 1 then 'calibration' when s_suppkey % 5 = 2 then 'latency' when s_suppkey % 5 = 3 then 'conformal' else 'choice' end",
    "source": "case when s_suppkey % 41 = 0 then 'guess' when s_suppkey % 2 = 0 then 'measured' else 'converted' end",
    "build": "concat('b', cast(s_suppkey - s_suppkey % 3 as string))",
    "dataset": "concat('ds', cast(s_suppkey % 4 as string))",
    "split": "case when s_suppkey % 3 = 0 then 'tuning' else 'test' end",
    "corruption": "case when s_suppkey % 6 = 0 then 'clean' else 'fade' end",
    "suite": "case when s_suppkey % 6 = 0 and s_suppkey % 18 <> 0 then null when s_suppkey % 25 = 1 then null else 'demo' end",
    "severity": "case when s_suppkey % 6 = 0 then 0 else s_suppkey % 6 + case when s_suppkey % 28 = 1 then 6 else 0 end end",
    "machine": "case when s_suppkey % 37 = 0 then 'laptop-2' else 'laptop-1' end",
    "device_label": "case when s_suppkey % 33 = 0 then 'phone' else 'laptop' end",
    "licence": "case when s_suppkey % 13 = 0 then null else 'Apache-2.0' end",
    "commit_id": f"case when s_suppkey % 11 = 0 then substr({_H}, 1, 10) else concat({_H}, substr({_H}, 1, 8)) end",
    "sha": f"case when s_suppkey % 19 = 0 then 'zz' when s_suppkey % 5 = 4 then null else concat({_H}, {_H}) end",
    "has_set_size": "s_suppkey % 5 = 3 and s_suppkey % 23 <> 3",
    "value": "case when s_suppkey % 47 = 0 then cast('NaN' as double) else s_acctbal / 10000 end",
    "lo": "case when s_suppkey % 16 = 0 then s_acctbal / 10000 + 0.01 else s_acctbal / 10000 - 0.01 end",
    "hi": "case when s_suppkey % 16 = 0 then s_acctbal / 10000 - 0.01 else s_acctbal / 10000 + 0.01 end",
    "n_items": "case when s_suppkey % 43 = 0 then 0 else 1000 + s_suppkey % 7 end",
    "sessions": "s_suppkey % 14",
}
_DOUBLE = {"value": "double", "lo": "double", "hi": "double"}


def records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(*[f"cast({e} as {_DOUBLE[n]}) as {n}" if n in _DOUBLE else f"{e} as {n}" for n, e in RECORD.items()])


CHECKS = {
    "dq_record": {
        "unknown version": "schema_version not in (1, 2)",
        "unknown kind": "kind not in ('accuracy', 'calibration', 'latency', 'conformal', 'choice')",
        "unknown source": "source not in ('measured', 'converted')",
        "no licence": "licence is null",
        "commit is not 40 hexadecimal digits": "not regexp_like(commit_id, '^[0-9a-f]{40}$')",
        "arrays without a checksum": "kind <> 'choice' and (sha is null or not regexp_like(sha, '^[0-9a-f]{64}$'))",
        "too few sessions": "kind = 'latency' and sessions < 2",
    },
    "dq_device": {"label does not match the machine": "device_label <> 'laptop'"},
    "dq_data_condition": {
        "no items": "n_items <= 0",
        "clean with a suite": "corruption = 'clean' and suite is not null",
        "clean with a severity": "corruption = 'clean' and severity <> 0",
        "damaged without a suite": "corruption <> 'clean' and suite is null",
        "severity not 1 to 5": "corruption <> 'clean' and (severity < 1 or severity > 5)",
    },
    "dq_metrics": {
        "value is not finite": "value is null or isnan(value)",
        "interval out of order": "lo > hi",
        "value outside its interval": "not isnan(value) and (value < least(lo, hi) or value > greatest(lo, hi))",
        "coverage without set size": "kind = 'conformal' and not has_set_size",
    },
    "dq_reliability": {"value not in [0, 1]": "kind = 'calibration' and not isnan(value) and (value < 0 or value > 1)", "interval not in [0, 1]": "kind = 'calibration' and (least(lo, hi) < 0 or greatest(lo, hi) > 1)"},
    "dq_coverage_pair": {"coverage without set size": "kind = 'conformal' and not has_set_size"},
    "dq_licences": {"licence missing or not the fixed one": "coalesce(licence, '') <> 'Apache-2.0'"},
    "dq_speed_rows": {"measured row without sessions": "kind = 'latency' and sessions = 0", "unmeasured row with a value": "kind <> 'latency' and sessions = 13 and value > 0.5"},
}


def builds(spark: SparkSession, sf: str) -> DataFrame:
    """A build for each supplier; three records in a row name one. Its own check's figures decide its status."""
    own = table(spark, sf, "supplier")
    return own.selectExpr("s_suppkey as n", "concat(case when s_suppkey % 54 = 0 then 'B' else 'b' end, cast(s_suppkey as string)) as build", "cast(case when s_suppkey % 4 = 3 then null else s_suppkey % 12 / 100000.0 end as double) as export_diff", "s_suppkey % 5 <> 2 as checks_ok", "cast(s_acctbal as double) / 10000 as agreement", "md5(cast(s_suppkey as string)) as sha")


def build_status() -> Column:
    return F.when(F.col("export_diff").isNull(), "no sanity check").when((F.col("export_diff") < 1e-4) & F.col("checks_ok") & (F.col("agreement") >= 0.20), "usable").otherwise("failed")


def flatten_json(docs: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """keys, path, value: a row for each leaf of JSON documents; a leaf's value is JSON text. Objects and arrays are opened a
    level at a time by built-in functions over variants, as many times as the deepest document has levels; empty ones are
    leaves. A null document has no leaves."""
    spark = docs.sparkSession
    level = docs.select(*keys, F.lit("").alias("path"), F.parse_json(F.col(doc)).alias("v")).filter("v is not null")
    leaves = None
    while True:
        level = level.withColumn("_open", F.expr("to_json(v) not in ('{}', '[]') and schema_of_variant(v) rlike '^(OBJECT|ARRAY)'"))
        own = level.filter("not _open").select(*keys, "path", F.to_json("v").alias("value"))
        leaves = own if leaves is None else leaves.unionByName(own)
        nested = written(spark, level.filter("_open").select(*keys, "path", F.to_json("v").alias("_text")), "nested")
        if nested.isEmpty():
            return leaves
        rows = spark.sql(f"select {', '.join(f'n.{k}' for k in keys)}, n.path as _above, e.pos, e.key, e.value as v from {{nested}} n, lateral variant_explode(parse_json(n._text)) e", nested=nested)
        path = F.when(F.col("key").isNull(), F.concat("_above", F.lit("["), "pos", F.lit("]"))).when(F.col("_above") == "", F.col("key")).otherwise(F.concat_ws(".", "_above", "key"))
        level = rows.select(*keys, path.alias("path"), "v")


def documents_json(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two generations of one document a supplier; the newer one differs in known places."""
    r = records(spark, sf)
    body = lambda v, c: F.to_json(F.struct(F.col("kind"), F.struct(v.alias("value"), F.array("id", F.lit(2)).alias("sizes")).alias("metric"), F.struct(c.alias("commit")).alias("source")))
    return r.select("id", body(F.col("n_items"), F.lit("a")).alias("doc")), r.select("id", body(F.col("n_items") + F.when(F.col("id") % 9 == 0, 1).otherwise(0), F.when(F.col("id") % 4 == 0, "b").otherwise("a")).alias("doc"))


def json_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Leaf-by-leaf differences of documents with the same id; null where a side lacks the leaf."""
    a = flatten_json(old, ["id"]).withColumnRenamed("value", "old")
    b = flatten_json(new, ["id"]).withColumnRenamed("value", "new")
    both = a.join(b, ["id", "path"], "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("group", F.when(F.col("path").startswith("source."), "source").otherwise("other"))


def q_json(spark: SparkSession, sf: str) -> DataFrame:
    return json_diff(*documents_json(spark, sf))


def q_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Differences that no listed change (path, old, new) allows."""
    allowed = spark.createDataFrame([("source.commit", '"a"', '"b"'), ("metric.value", "1000", "1001")], "path string, old string, new string")
    return q_json(spark, sf).join(F.broadcast(allowed), ["path", "old", "new"], "left_anti").select("id", "path", "old", "new")


def upgraded(r: DataFrame) -> DataFrame:
    """Version 1 records as version 2: the runtime is looked up in the record of the same build that is version 2."""
    source = r.filter("schema_version = 2").groupBy("build").agg(F.min("id").alias("runtime_from"))
    one = r.filter("schema_version = 1").join(source, "build", "left")
    return one.select("id", "name", "build", F.lit(2).alias("schema_version"), "runtime_from", F.when(F.col("runtime_from").isNull(), "no record to take the runtime from").alias("error"))


QUERIES = {
    **{n: (lambda n: lambda s, d: problems(records(s, d), ["id", "name"], CHECKS[n]))(n) for n in CHECKS},
    "dq_kind_counts": lambda s, d: records(s, d).groupBy("kind", "source").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin("choice", "other")).alias("skipped")),
    "dq_unusable_used": lambda s, d: records(s, d).join(builds(s, d).filter(build_status() != "usable"), "build", "left_semi").select("id", "build"),
    "dq_label_fk": lambda s, d: missing(records(s, d), builds(s, d).filter("n % 21 <> 0"), ["build"]).select("id", "build"),
    "dq_ids_unique": lambda s, d: records(s, d).groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"),
    "dq_one_machine": lambda s, d: records(s, d).groupBy("dataset").agg(F.count_distinct("machine").alias("machines")).withColumn("ok", F.col("machines") == 1),
    "dq_build_record": lambda s, d: problems(builds(s, d), ["build"], {"no sanity figures": "export_diff is null", "a check failed": "not checks_ok", "little agreement": "agreement < 0.2"}),
    "dq_values_equal_source": lambda s, d: records(s, d).join(records(s, d).select("id", F.col("n_items").alias("copied")).withColumn("copied", F.when(F.col("id") % 21 == 0, F.col("copied") + 1).otherwise(F.col("copied"))), "id").filter(~F.col("n_items").eqNullSafe(F.col("copied"))).select("id", "n_items", "copied"),
    "dq_json_diff": q_json,
    "dq_allowed_changes": q_allowed,
    "rule_build_status": lambda s, d: builds(s, d).select("build", build_status().alias("status")),
    "rec_duplicate_names": lambda s, d: records(s, d).filter("schema_version = 1").groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"),
    "rec_filter_accuracy": lambda s, d: records(s, d).filter("kind = 'accuracy' and split = 'test' and sha is not null and schema_version = 2").select("id", "build"),
    "rec_v1_to_v2": lambda s, d: upgraded(records(s, d)),
    "lab_sources": lambda s, d: records(s, d).select("name", "sha").filter("sha is not null").distinct(),
    "lab_load_sorted": lambda s, d: records(s, d).filter("schema_version = 2").groupBy(F.lower("name").alias("address")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn("duplicate", F.col("n") > 1),
    "lab_document": lambda s, d: records(s, d).groupBy("build").agg(F.to_json(F.struct(F.first("build").alias("build_id"), F.array_sort(F.collect_list(F.struct("id", "kind", "dataset"))).alias("measurements"))).alias("document")),
    "work_grid_todo": lambda s, d: builds(s, d).filter(build_status() == "usable").select("build").crossJoin(written(s, records(s, d).select("dataset").distinct(), "datasets")).join(records(s, d).filter("schema_version = 2 and sha is not null").select("build", "dataset").distinct(), ["build", "dataset"], "left_anti"),
}
_REC = "with r as materialized (select " + ", ".join(f"({e})::{_DOUBLE[n]} as {n}" if n in _DOUBLE else f"{e} as {n}" for n, e in RECORD.items()) + " from supplier)"
_BUILDS = "b as (select *, case when export_diff is null then 'no sanity check' when export_diff < 1e-4::double and checks_ok and agreement >= 0.20::double then 'usable' else 'failed' end status from (select s_suppkey n, concat(case when s_suppkey % 54 = 0 then 'B' else 'b' end, s_suppkey::varchar) build, (case when s_suppkey % 4 = 3 then null else s_suppkey % 12 / 100000.0 end)::double export_diff, s_suppkey % 5 <> 2 checks_ok, s_acctbal::double / 10000 agreement from supplier))"


def _problems_sql(rows: str, keys: str, checks: dict[str, str]) -> str:
    cases = ", ".join(f"case when {c.replace('regexp_like(', 'regexp_matches(')} then '{n}' end" for n, c in checks.items())
    return f"select {keys}, problem from (select {keys}, unnest([{cases}]) problem from {rows}) where problem is not null"


ORACLE = {
    **{n: f"{_REC} {_problems_sql('r', 'id, name', c)}" for n, c in CHECKS.items()},
    "dq_kind_counts": f"{_REC} select kind, source, count(*) n, count(*) filter (kind in ('choice', 'other')) skipped from r group by 1, 2",
    "dq_unusable_used": f"{_REC}, {_BUILDS} select id, build from r where build in (select build from b where status <> 'usable')",
    "dq_label_fk": f"{_REC}, {_BUILDS} select id, build from r where build not in (select build from b where n % 21 <> 0)",
    "dq_ids_unique": f"{_REC} select name, count(*) n from r group by 1 having count(*) > 1",
    "dq_one_machine": f"{_REC} select dataset, count(distinct machine) machines, count(distinct machine) = 1 ok from r group by 1",
    "dq_build_record": f"with {_BUILDS} " + _problems_sql("b", "build", {"no sanity figures": "export_diff is null", "a check failed": "not checks_ok", "little agreement": "agreement < 0.2::double"}),
    "dq_values_equal_source": f"{_REC} select id, n_items, n_items + 1 copied from r where id % 21 = 0",
    "dq_json_diff": f"{_REC} select id, 'metric.value' path, n_items::varchar old, (n_items + 1)::varchar as new, 'other' as \"group\" from r where id % 9 = 0 union all select id, 'source.commit', '\"a\"', '\"b\"', 'source' from r where id % 4 = 0",
    "dq_allowed_changes": f"{_REC} select id, 'metric.value' path, n_items::varchar old, (n_items + 1)::varchar as new from r where id % 9 = 0 and n_items <> 1000",
    "rule_build_status": f"with {_BUILDS} select build, status from b",
    "rec_duplicate_names": f"{_REC} select name, count(*) n from r where schema_version = 1 group by 1 having count(*) > 1",
    "rec_filter_accuracy": f"{_REC} select id, build from r where kind = 'accuracy' and split = 'test' and sha is not null and schema_version = 2",
    "rec_v1_to_v2": f"{_REC} select id, name, r.build, 2 schema_version, runtime_from, case when runtime_from is null then 'no record to take the runtime from' end error from r left join (select build, min(id) runtime_from from r where schema_version = 2 group by 1) s on r.build = s.build where schema_version = 1",
    "lab_sources": f"{_REC} select distinct name, sha from r where sha is not null",
    "lab_load_sorted": f"{_REC} select lower(name) address, count(*) n, min(id) first_id, count(*) > 1 as duplicate from r where schema_version = 2 group by 1",
    "lab_document": f"{_REC} select build, '{{\"build_id\":\"' || build || '\",\"measurements\":[' || string_agg('{{\"id\":' || id || ',\"kind\":\"' || kind || '\",\"dataset\":\"' || dataset || '\"}}', ',' order by id) || ']}}' as document from r group by 1",
    "work_grid_todo": f"{_REC}, {_BUILDS} select b.build, d.dataset from b cross join (select distinct dataset from r) d where status = 'usable' and not exists (select 1 from r where r.build = b.build and r.dataset = d.dataset and schema_version = 2 and sha is not null)",
}
