"""Label assembly and its checks: facts in long form, envelope and speed rows, verdicts by rule rows, re-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixtures import CTE, duck, table
from plumbline.operators import rules as R
from plumbline.operators.compare import _FACTS, B, _f, damaged, judged
from plumbline.operators.latency import _T, lat_summarise, timings
from plumbline.operators.metrics import r9, scored
from plumbline.operators.outcomes import CELL
from plumbline.operators.quality import _BUILDS, _REC, build_status, builds, records
from plumbline.operators.quantise import _TN, quantised, restored, tensors, vectors
from plumbline.operators.resample import _FAST, _GAP, _Q, _SIDE, boot_sums, bs_paired_diff, bs_variant_change, interval, outcomes_fast

METRICS = ["top1", "coverage", "mean_size", "drop", "cost"]
ENDS = {"coverage": "cov", "drop": "drop", "cost": "cost"}


def measurements(facts: DataFrame) -> DataFrame:
    """The long fact: a row for each metric of each cell, with its interval where it has one."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), (F.col(f"{ENDS[m]}_lo") if m in ENDS else F.lit(None).cast("double")).alias("lo"), (F.col(f"{ENDS[m]}_hi") if m in ENDS else F.lit(None).cast("double")).alias("hi")) for m in METRICS])
    return facts.select(*CELL, "n", F.explode(rows).alias("x")).select(*CELL, "n", "x.*")


def envelope_rows(rows: DataFrame, failed: list[str]) -> DataFrame:
    """Rows of usable builds, and for each failed build the fixed row in every condition."""
    own = rows.select("build", "cond_id", "state", "flags")
    spark = rows.sparkSession
    broken = rows.select("cond_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(b,) for b in failed], "build string")))
    return own.unionByName(broken.select("build", "cond_id", F.lit("INT8 build failed").alias("state"), F.lit("").alias("flags")))


def speed_rows(t: DataFrame, failed: list[str], devices: list[str]) -> DataFrame:
    """Measured rows, "not measured" for failed builds, and a row for each device that was not measured."""
    spark = t.sparkSession
    own = lat_summarise(t, ["build"]).select("build", F.lit("laptop").alias("device"), F.lit("measured").alias("status"), "p50_ms")
    none = F.lit(None).cast("double").alias("p50_ms")
    more = spark.createDataFrame([(b,) for b in failed], "build string").select("build", F.lit("laptop").alias("device"), F.lit("not measured: build failed").alias("status"), none)
    away = own.select("build").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in devices], "device string"))).select("build", "device", F.lit("not measured").alias("status"), none)
    return own.unionByName(more).unionByName(away)


def published(rows: DataFrame) -> DataFrame:
    """The rows as published, with planted faults: one state, one list of failed lines, one cost."""
    fade5, jitter3 = F.col("cond_id") == "demo/fade/5", F.col("cond_id") == "demo/jitter/3"
    return rows.withColumns(
        {
            "state": F.when(fade5 & (F.col("build") == "ref"), "not harmful").otherwise(F.col("state")),
            "failed_lines": F.when(jitter3 & (F.col("build") == "small"), "").otherwise(F.col("failed_lines")),
            "cost": F.when(jitter3, F.col("cost") + 0.001).otherwise(F.col("cost")),
        }
    )


def envelope_consistency(rows: DataFrame) -> DataFrame:
    """Harmful if and only if a line failed; failed lines equal the line states."""
    want = R.joined((F.col("drop_state") == "fails", "damage drop"), (F.col("cov_state") == "fails", "coverage"))
    found = F.array(F.when((F.col("state") == "harmful") != (F.col("failed_lines") != ""), "state and failed lines disagree"), F.when(F.col("failed_lines") != want, "failed lines and line states disagree"))
    return rows.select("build", "cond_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def recompute(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Published rows that a second computation does not give, and the other way round."""
    cols = ["build", "cond_id", "state", "failed_lines", r9(F.col("cost")).alias("cost")]
    a, b = rows.select(*cols), again.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("published")).unionByName(b.exceptAll(a).withColumn("side", F.lit("recomputed")))


def summary_consistency(rows: DataFrame) -> DataFrame:
    """Per build: conditions tested, distinct ones, and whether each has exactly one row and a known state."""
    return rows.groupBy("build").agg(F.count("*").alias("n"), F.count_distinct("cond_id").alias("conditions"), F.count_if(F.col("state").isin("harmful", "borderline", "not harmful")).alias("known")).withColumn("ok", (F.col("n") == F.col("conditions")) & (F.col("n") == F.col("known")))


def label_structure(b: DataFrame) -> DataFrame:
    """Build ids by their pattern; failed builds, and only they, carry a failure."""
    own = b.withColumn("status", build_status())
    found = F.array(F.when(~F.col("build").rlike("^b[0-9]+$"), "id does not match its pattern"), F.when((F.col("status") == "failed") & F.col("checks_ok") & (F.col("agreement") >= 0.2), "failed without a failure"), F.when((F.col("status") == "usable") & F.col("export_diff").isNull(), "usable without a check"))
    return own.select("build", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


#: Rules as rows: name, cell, metric, comparison, threshold.
HYPOTHESES = [
    ("h10", "small", "clean", "top1", ">=", 0.679), ("h11", "small", "clean", "drop", ">=", -0.10), ("h12", "small", "demo/fade/5", "drop", ">=", -0.10), ("h13", "small", "clean", "cost", ">=", -0.01),
    ("h14", "ref", "demo/fade/3", "coverage", ">=", 0.03), ("h15", "small", "demo/fade/3", "mean_size", "<=", 2.0), ("h16", "ref", "demo/jitter/5", "top1", "<", 0.10), ("h17", "small", "demo/jitter/3", "coverage", "<", 0.88),
]


def judge(facts: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """PASS or FAIL of each rule row; NOT RUN where its cell is missing."""
    own = measurements(facts).select("build", "cond_id", "metric", "value")
    both = hypotheses.join(own, ["build", "cond_id", "metric"], "left")
    holds = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return both.select("name", "metric", "value", "threshold", F.when(F.col("value").isNull(), "NOT RUN").when(holds, "PASS").otherwise("FAIL").alias("verdict"))


def tensor_extra(spark: SparkSession, sf: str) -> DataFrame:
    """item, tensor, x = clean minus damaged SQNR."""
    t = tensors(vectors(spark, sf))
    return t.filter("cond = 'clean'").select("item", "tensor", F.col("db").alias("a")).join(t.filter("cond = 'damaged'").select("item", "tensor", F.col("db").alias("b")), ["item", "tensor"]).select("item", "tensor", F.round(F.col("a") - F.col("b"), 6).alias("x"))


def median_ci(rows: DataFrame, early: int, b: int = B) -> DataFrame:
    """Intervals of the medians over tensors, recomputed in each replicate: early block, rest, difference."""
    means = boot_sums(rows, ["tensor"], ["x"], b).select("tensor", "b", (F.col("x") / F.col("sw")).alias("e"))
    each = means.groupBy("b").agg(F.median(F.when(F.col("tensor") < early, F.col("e"))).alias("early"), F.median(F.when(F.col("tensor") >= early, F.col("e"))).alias("rest"))
    long = each.select("b", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c.alias("v")) for n, c in (("early", F.col("early")), ("rest", F.col("rest")), ("early minus rest", F.col("early") - F.col("rest")))])).alias("x")).select("b", "x.*")
    p = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("part").agg(p.alias("p")).select("part", F.round(F.col("p")[0], 5).alias("lo"), F.round(F.col("p")[1], 5).alias("hi"))


def per_group_ci(rows: DataFrame, b: int = B, top: int = 5) -> DataFrame:
    """The tensors with the highest mean, each with its interval."""
    own = rows.groupBy("tensor").agg(F.round(F.avg("x"), 5).alias("value")).orderBy(F.desc("value"), "tensor").limit(top)
    means = boot_sums(rows, ["tensor"], ["x"], b).withColumn("v", F.col("x") / F.col("sw"))
    p = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return own.join(means.groupBy("tensor").agg(p.alias("p")), "tensor").select("tensor", "value", F.round(F.col("p")[0], 5).alias("lo"), F.round(F.col("p")[1], 5).alias("hi"))


def q_rule_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct levels an item uses, damaged against clean: SUPPORTS if down by 20% or more with the interval below 0,
    REJECTS if the interval's upper end is not below 0."""
    q = quantised(vectors(spark, sf))
    dark = q.withColumn("x", F.col("x") * 0.25).withColumn("level", F.rint(restored() / F.col("scale") + F.col("zero")).cast("int"))
    a = q.groupBy("item").agg(F.count_distinct("level").cast("double").alias("a"))
    d = dark.groupBy("item").agg(F.count_distinct("level").cast("double").alias("d"))
    both = a.join(d, "item").withColumns({"x": F.col("d") - F.col("a"), "k": F.lit("all")})
    point = both.groupBy("k").agg(F.avg("a").alias("clean"), F.avg("x").alias("change"))
    own = point.join(interval(boot_sums(both, ["k"], ["x"], B), ["k"], F.col("x") / F.col("sw")), "k")
    verdict = F.when((F.col("hi") < 0) & (F.col("change") <= -0.20 * F.col("clean")), "SUPPORTS").when(F.col("hi") >= 0, "REJECTS").otherwise("INCONCLUSIVE")
    return own.select(r9(F.col("clean")).alias("clean"), r9(F.col("change")).alias("change"), "lo", "hi", verdict.alias("verdict"))


def q_rule_variant(spark: SparkSession, sf: str) -> DataFrame:
    """A variant must recover half of the baseline's loss, in whole items, with its interval above zero."""
    ch = bs_variant_change(outcomes_fast(spark, sf, 2, ["clean", "demo/fade/5"]), "m0", "m1", "demo/fade/5")
    no_loss = F.col("baseline") * 100 > -2 * F.col("n")
    recovers = (2 * F.col("count") >= -F.col("baseline")) & (F.col("lo") > 0)
    return ch.select("cond_id", "count", "baseline", (F.abs("count") * 100 < 2 * F.col("n")).alias("control_holds"), F.when(no_loss, "NOT JUDGED").when(recovers, "PASS").otherwise("FAIL").alias("verdict"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    j = judged(spark, sf)
    is_clean, small = F.col("cond_id") == "clean", F.col("build") == "small"
    return j.groupBy("model").agg(
        F.max(F.when(is_clean & ~small, F.col("top1"))).alias("ref_top1"), F.max(F.when(is_clean & small, F.col("top1"))).alias("small_top1"), F.max(F.when(is_clean & small, F.col("cost"))).alias("cost"),
        F.count_if(~is_clean & small & (F.col("state") == "harmful")).alias("harmful"), F.count_if(~is_clean & small & (F.col("flags") != "")).alias("flagged"),
    )


def runtime_match(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements whose copied runtime differs from their record's."""
    r = records(spark, sf)
    copied = r.select("id", F.when(F.col("id") % 15 == 0, "elsewhere").otherwise(F.col("machine")).alias("copied"))
    return r.join(copied, "id").filter(~F.col("machine").eqNullSafe(F.col("copied"))).select("id", "machine", "copied")


def build_match(spark: SparkSession, sf: str) -> DataFrame:
    """Named builds against the build records: unknown ones, and those whose status is copied wrongly."""
    b = builds(spark, sf).withColumn("status", build_status())
    named = b.filter("n % 17 <> 3").select("build", F.when(F.col("n") % 17 == 4, "usable?").otherwise(F.col("status")).alias("named_status"))
    both = b.join(named, "build", "left")
    return both.filter(~F.col("status").eqNullSafe(F.col("named_status"))).select("build", F.when(F.col("named_status").isNull(), "not named").otherwise("status differs").alias("problem"))


def speed_source(spark: SparkSession, sf: str) -> DataFrame:
    """Speed rows against their timings, field by field."""
    own = lat_summarise(timings(spark, sf), ["build", "session"])
    copy = own.withColumns({"p50_ms": F.when(F.col("session") == 2, F.col("p50_ms") + 1).otherwise(F.col("p50_ms")), "p99_ms": F.when(F.col("session") == 4, F.lit(None)).otherwise(F.col("p99_ms"))})
    fields = ["p50_ms", "p95_ms", "p99_ms"]
    both = own.alias("a").join(copy.alias("b"), ["build", "session"])
    wrong = F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields])
    return both.select("build", "session", F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("field"))


def size_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.round(F.sum(F.octet_length("text")) / 1e6, 6).alias("mb"))


QUERIES = {
    "fn_ci_side": lambda s, d: bs_paired_diff(scored(s, d), B).select("model", "cond_id", "side"),
    "bs_median_ci": lambda s, d: median_ci(tensor_extra(s, d), 1),
    "bs_per_group_ci": lambda s, d: per_group_ci(tensor_extra(s, d)),
    "cmp_catalog": catalog,
    "cmp_figure_values": lambda s, d: measurements(judged(s, d)).filter("metric in ('top1', 'cost')").select(F.when(F.col("metric") == "top1", "hero").otherwise("uncertainty").alias("figure"), F.concat_ws("/", "build", "cond_id").alias("value_id"), "value", "lo", "hi"),
    "cmp_size_rows": size_rows,
    "rule_levels": q_rule_levels,
    "rule_variant": q_rule_variant,
    "rule_judge_h10_h17": lambda s, d: judge(judged(s, d), s.createDataFrame(HYPOTHESES, "name string, build string, cond_id string, metric string, op string, threshold double")),
    "dq_label_structure": lambda s, d: label_structure(builds(s, d)),
    "dq_envelope_consistency": lambda s, d: envelope_consistency(published(damaged(s, d))),
    "dq_summary_consistency": lambda s, d: summary_consistency(published(damaged(s, d))),
    "dq_recompute": lambda s, d: recompute(published(damaged(s, d)), damaged(s, d)),
    "dq_runtime_match": runtime_match,
    "dq_build_match": build_match,
    "dq_speed_source": speed_source,
    "lab_measurements": lambda s, d: measurements(judged(s, d)),
    "lab_envelope_rows": lambda s, d: envelope_rows(damaged(s, d), ["broken"]),
    "lab_speed_rows": lambda s, d: speed_rows(timings(s, d), ["broken"], ["phone", "board"]),
}
_C = "model, build, cond_id"
_LONG = " union all ".join(f"select {_C}, n, '{m}' metric, {'drop_' if m == 'drop' else m}::double as value, {ENDS[m] + '_lo' if m in ENDS else 'null::double'} lo, {ENDS[m] + '_hi' if m in ENDS else 'null::double'} hi from judged" for m in METRICS)
_PUB = """pub as (select * replace (case when cond_id = 'demo/fade/5' and build = 'ref' then 'not harmful' else state end as state, case when cond_id = 'demo/jitter/3' and build = 'small' then '' else failed_lines end as failed_lines, round(case when cond_id = 'demo/jitter/3' then cost + 0.001::double else cost end, 9) as cost) from damaged)"""


def _p(sql: str) -> str:
    return duck(sql, "sets", "weights", more=f"{_FACTS}, {_PUB}", b=B)


_X = f"{_TN}, xs as materialized (select a.item, a.tensor, round(a.db - c.db, 6) x from t a join t c using (item, tensor) where a.cond = 'clean' and c.cond = 'damaged'), items as (select vec_id item from embeddings), {CTE['weights'](b=B)}, xm as (select tensor, b, sum(w * x) / sum(w) v from xs join weights using (item) group by 1, 2)"
_LV = f"{_TN}, lv as (select a.item, a.n::double a, c.n::double d from (select item, count(distinct lv) n from q group by 1) a join (select item, count(distinct greatest(0, least(255, round_even(x * 0.25::double / scale, 0) + zero))) n from q group by 1) c using (item)), items as (select vec_id item from embeddings), {CTE['weights'](b=B)}"
_HYP = "hyp(name, build, cond_id, metric, op, threshold) as (values " + ", ".join(f"('{n}', '{b}', '{c}', '{m}', '{o}', {t}::double)" for n, b, c, m, o, t in HYPOTHESES) + ")"
ORACLE = {
    "fn_ci_side": duck(f"select model, cond_id, {_SIDE} from (select model, cond_id, {_Q} from (select model, cond_id, b, sum(w * x) / sum(w) v from pairs join weights using (item) group by all) group by all)", "scores", "weights", more=f"{_FAST}, pairs as materialized (select a.model, a.cond_id, a.item, b.correct - a.correct x from fast a join fast b using (model, cond_id, item) where a.build = 'ref' and b.build = 'small')", b=B),
    "bs_median_ci": f"{_X}, md as (select b, median(v) filter (tensor < 1) e, median(v) filter (tensor >= 1) r from xm group by 1), lg as (select 'early' part, e v from md union all select 'rest', r from md union all select 'early minus rest', e - r from md) select part, round(quantile_cont(v, 0.025::double), 5) lo, round(quantile_cont(v, 0.975::double), 5) hi from lg group by 1",
    "bs_per_group_ci": f"{_X} select tensor, value, lo, hi from (select tensor, round(avg(x), 5) as value from xs group by 1 order by 2 desc, 1 limit 5) join (select tensor, round(quantile_cont(v, 0.025::double), 5) lo, round(quantile_cont(v, 0.975::double), 5) hi from xm group by 1) using (tensor)",
    "cmp_catalog": _f("select model, max(top1) filter (cond_id = 'clean' and build = 'ref') ref_top1, max(top1) filter (cond_id = 'clean' and build = 'small') small_top1, max(cost) filter (cond_id = 'clean' and build = 'small') as cost, count(*) filter (cond_id <> 'clean' and build = 'small' and state = 'harmful') harmful, count(*) filter (cond_id <> 'clean' and build = 'small' and flags <> '') flagged from judged group by 1"),
    "cmp_figure_values": _f("select 'hero' figure, build || '/' || cond_id value_id, top1 as value, null::double lo, null::double hi from judged union all select 'uncertainty', build || '/' || cond_id, cost, cost_lo, cost_hi from judged"),
    "cmp_size_rows": "select source, round(sum(strlen(text)) / 1e6::double, 6) mb from documents group by 1",
    "rule_levels": f"{_LV} select round(c, 9) clean, round(x, 9) change, lo, hi, case when hi < 0 and x <= -0.20::double * c then 'SUPPORTS' when hi >= 0 then 'REJECTS' else 'INCONCLUSIVE' end verdict from (select avg(a) c, avg(d - a) x from lv), (select {_Q} from (select b, sum(w * (d - a)) / sum(w) v from lv join weights using (item) group by 1))",
    "rule_variant": duck(f"select cond_id, c as count, baseline, abs(c) * 100 < 2 * n control_holds, case when baseline * 100 > -2 * n then 'NOT JUDGED' when 2 * c >= -baseline and lo > 0 then 'PASS' else 'FAIL' end verdict from (select cond_id, count(*) n, sum(x)::bigint c, sum(xb)::bigint baseline from pairs group by 1) join (select cond_id, {_Q} from (select cond_id, b, sum(w * x) / sum(w) v from pairs join weights using (item) group by all) group by 1) using (cond_id)", "scores", "weights", more=f"{_FAST}, {_GAP}, pairs as materialized (select a.cond_id, a.item, a.x xb, b.x - a.x x from extra a join extra b using (cond_id, item) where a.model = 'm0' and b.model = 'm1')", models=2, conds=["clean", "demo/fade/5"]),
    "rule_judge_h10_h17": duck("select name, metric, value, threshold, case when value is null then 'NOT RUN' when case op when '>=' then value >= threshold when '<=' then value <= threshold else value < threshold end then 'PASS' else 'FAIL' end verdict from hyp left join lg using (build, cond_id, metric)", "sets", "weights", more=f"{_FACTS}, {_HYP}, lg as ({_LONG})", b=B),
    "dq_label_structure": f"with {_BUILDS} select build, 'id does not match its pattern' problem from b where not regexp_matches(build, '^b[0-9]+$') union all select build, 'failed without a failure' from b where status = 'failed' and checks_ok and agreement >= 0.2::double",
    "dq_envelope_consistency": _p("select build, cond_id, 'state and failed lines disagree' problem from pub where (state = 'harmful') <> (failed_lines <> '') union all select build, cond_id, 'failed lines and line states disagree' from pub where failed_lines <> concat_ws('; ', case when drop_state = 'fails' then 'damage drop' end, case when cov_state = 'fails' then 'coverage' end)"),
    "dq_summary_consistency": _p("select build, count(*) n, count(distinct cond_id) conditions, count(*) filter (state in ('harmful', 'borderline', 'not harmful')) known, true ok from pub group by 1"),
    "dq_recompute": _p("(select build, cond_id, state, failed_lines, cost, 'published' side from (select build, cond_id, state, failed_lines, cost from pub except all select build, cond_id, state, failed_lines, cost from damaged)) union all (select build, cond_id, state, failed_lines, cost, 'recomputed' from (select build, cond_id, state, failed_lines, cost from damaged except all select build, cond_id, state, failed_lines, cost from pub))"),
    "dq_runtime_match": f"{_REC} select id, machine, 'elsewhere' copied from r where id % 15 = 0",
    "dq_build_match": f"with {_BUILDS} select build, case when n % 17 = 3 then 'not named' else 'status differs' end problem from b where n % 17 in (3, 4)",
    "dq_speed_source": f"{_T} select build, session, 'p50_ms' field from s where session = 2 union all select build, session, 'p99_ms' from s where session = 4",
    "lab_measurements": _f(_LONG),
    "lab_envelope_rows": _f("select build, cond_id, state, flags from damaged union all select 'broken', cond_id, 'INT8 build failed', '' from (select distinct cond_id from damaged)"),
    "lab_speed_rows": f"{_T}, m as (select build, round(quantile_cont(ms, 0.5::double), 9) p50_ms from t group by 1) select build, 'laptop' device, 'measured' status, p50_ms from m union all select 'broken', 'laptop', 'not measured: build failed', null union all select build, device, 'not measured', null from m cross join (values ('phone'), ('board')) x(device)",
}
