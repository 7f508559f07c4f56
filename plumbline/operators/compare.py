"""Comparisons over cells: paired facts of every build and condition, rules applied to them, tables and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.fixtures import conditions, duck
from plumbline.operators import rules as R
from plumbline.operators.metrics import r9, set_rows
from plumbline.operators.outcomes import CELL
from plumbline.operators.resample import _FAST, _GAP, _NINE, _Q, _RHO, _TOPS, B, _rank, boot_sums, difference_ci, extra_gaps, outcomes_fast, stat_corr_judged, stat_spearman, tops
from plumbline.shared import written


def facts(df: DataFrame, b: int = B) -> DataFrame:
    """A row for each cell: top-1, coverage, damage drop (condition minus clean) and shrinking cost (shrunk minus
    reference), all on the same items and the same replicates, each with its 95% interval."""
    # an item's few cells; both windows keep the partitions of the items
    beside = lambda test, key: F.max(F.when(test, F.col("correct"))).over(Window.partitionBy("model", "item", key))
    clean, ref = beside(F.col("cond_id") == "clean", "build"), beside(F.col("build") == "ref", "cond_id")
    own = df.select(*CELL, "item", "correct", "covered", "size", clean.alias("_clean"), ref.alias("_ref")).filter("_clean is not null and _ref is not null")
    own = own.withColumns({"drop": F.col("correct") - F.col("_clean"), "cost": F.col("correct") - F.col("_ref")})
    values = {"correct": "top1", "covered": "coverage", "size": "mean_size", "drop": "drop", "cost": "cost", "_ref": "ref_top1"}
    sums = written(df.sparkSession, boot_sums(own, CELL, list(values), b, plain=True), "sums")
    point = sums.filter("b = -1").select(*CELL, F.col("sw").cast("long").alias("n"), *[r9(F.col(v) / F.col("sw")).alias(n) for v, n in values.items()])
    ends = F.array(F.lit(0.025), F.lit(0.975))
    wide = sums.filter("b >= 0").groupBy(*CELL).agg(*[F.percentile(F.col(v) / F.col("sw"), ends).alias(f"_{v}") for v in ("covered", "drop", "cost")])
    named = wide.select(*CELL, *[r9(F.col(f"_{v}")[i]).alias(f"{p}_{e}") for v, p in (("covered", "cov"), ("drop", "drop"), ("cost", "cost")) for i, e in enumerate(("lo", "hi"))])
    return point.join(named, CELL)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return R.envelope(facts(set_rows(spark, sf)), R.rules(spark))


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).filter("cond_id <> 'clean'")


def caused(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_cause(damaged(spark, sf))


def label_summary(own: DataFrame) -> DataFrame:
    """Conditions of the shrunk build grouped by state and cause, with their names in order."""
    listed = F.array_join(F.array_sort(F.collect_list("cond_id")), ",")
    return own.groupBy("model", "state", "cause").agg(F.count("*").alias("n"), listed.alias("conditions"), F.count_if(F.col("failed_lines") == "damage drop").alias("accuracy_only"), F.count_if(F.col("failed_lines") == "coverage").alias("coverage_only"), F.count_if(F.col("failed_lines") == "damage drop; coverage").alias("both_lines"))


def harm_counts(rows: DataFrame) -> DataFrame:
    """States and failed lines per model and build, with a total over all models."""
    counts = {"not_harmful": "state = 'not harmful'", "borderline": "state = 'borderline'", "harmful": "state = 'harmful'", "accuracy_only": "failed_lines = 'damage drop'", "coverage_only": "failed_lines = 'coverage'", "both_lines": "failed_lines = 'damage drop; coverage'"}
    return rows.groupingSets([[F.col("model"), F.col("build")], [F.col("build")]], "model", "build").agg(F.count("*").alias("n"), *[F.count_if(F.expr(c)).alias(k) for k, c in counts.items()]).withColumn("model", F.coalesce("model", F.lit("all models")))


def cause_counts(own: DataFrame) -> DataFrame:
    return own.filter("cause = 'too hard for this model'").groupBy("model").agg(F.count("*").alias("too_hard"), *[F.count_if(F.col("ref_failed") == v).alias(k) for k, v in (("ref_accuracy_only", "damage drop"), ("ref_coverage_only", "coverage"), ("ref_both", "damage drop; coverage"))])


def summary_counts(own: DataFrame) -> DataFrame:
    kinds = ["not harmful", "borderline", "too hard for this model", "hurt by shrinking", "cause unclear"]
    return own.withColumn("_key", F.coalesce("cause", "state")).groupBy("model").pivot("_key", kinds).count()


def closest_to_line(rows: DataFrame) -> DataFrame:
    """The damaged condition nearest each line, per model and build."""
    long = rows.select("model", "build", "cond_id", F.explode(F.array(
        F.struct(F.lit("coverage").alias("metric"), R.distance(F.col("cov_lo"), F.col("cov_hi"), F.col("coverage_min")).alias("distance")),
        F.struct(F.lit("damage drop").alias("metric"), R.distance(F.col("drop_lo"), F.col("drop_hi"), F.col("drop_min")).alias("distance")),
    )).alias("x")).select("model", "build", "cond_id", "x.*")
    best = F.min_by(F.struct("cond_id", "distance"), F.struct(F.abs("distance").alias("a"), "cond_id"))
    return long.groupBy("model", "build", "metric").agg(best.alias("b")).select("model", "build", "metric", F.col("b.cond_id").alias("cond_id"), r9(F.col("b.distance")).alias("distance"))


def heat_step(cost: str = "cost", edges: tuple[float, ...] = (0.01, 0.05, 0.15)) -> Column:
    loss = -F.col(cost)
    return F.when(loss <= 0, 0).otherwise(1 + sum((F.round(loss, 9) >= e).cast("int") for e in edges))


def series(rows: DataFrame) -> DataFrame:
    """top-1 by build and corruption for severities 0 to 5; severity 0 is the clean value, repeated for each corruption."""
    kinds = rows.filter("severity > 0").select("corruption").distinct()
    clean = rows.filter("cond_id = 'clean'").drop("corruption").crossJoin(F.broadcast(kinds))
    both = rows.filter("severity > 0").unionByName(clean)
    return both.groupBy("model", "build", "corruption").pivot("severity", [0, 1, 3, 5]).agg(F.first("top1")).toDF("model", "build", "corruption", "s0", "s1", "s3", "s5")


def reproduction(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Two runs' scores: items only one has, answers that differ, identical scores, largest difference; per cell."""
    a = old.select(*on, F.col("z").alias("za"), F.lit(True).alias("_a"))
    b = new.select(*on, F.col("z").alias("zb"), F.lit(True).alias("_b"))
    both = a.join(b, on, "full")
    best = lambda z: F.array_position(z, F.array_max(z))
    gap = F.array_max(F.zip_with("za", "zb", lambda x, y: F.abs(x - y)))
    keys = [c for c in on if c != "item"]
    out = both.groupBy(*keys).agg(
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unpaired"), F.count("*").alias("n"), F.count_if(best(F.col("za")) != best(F.col("zb"))).alias("top1_differs"), F.count_if(gap == 0).alias("identical"), r9(F.max(gap)).alias("largest_difference")
    )
    return out.withColumn("ok", (F.col("unpaired") == 0) & (F.col("top1_differs") <= F.floor(F.col("n") / 1000)))


def breadth_table(t: DataFrame) -> DataFrame:
    return t.withColumns({"minus_clean": r9(F.col("ref") - F.col("ref0")), "near_floor": F.col("ref") < 0.10, "ratio": r9(F.col("small") / F.nullif("ref", F.lit(0.0)))}).select("model", "cond_id", "ref", "minus_clean", "near_floor", "small", "gap", "ratio", "extra")


def q_series(spark: SparkSession, sf: str) -> DataFrame:
    t = outcomes_fast(spark, sf, 1, None).groupBy("model", "build", "cond_id").agg(r9(F.avg("correct")).alias("top1"))
    return series(t.join(F.broadcast(conditions(spark)), "cond_id").select("model", "build", "cond_id", "corruption", "severity", "top1"))


def q_reproduction(spark: SparkSession, sf: str) -> DataFrame:
    from plumbline.fixtures import scores

    old = scores(spark, sf, conds=["clean"])
    again = old.filter("item % 1009 <> 0").withColumn("z", F.transform("z", lambda x: F.when(F.col("item") % 97 == 0, x + 0.001).otherwise(x)))
    return reproduction(old, again, ["model", "build", "cond_id", "item"])


def q_clean_check(spark: SparkSession, sf: str) -> DataFrame:
    return q_reproduction(spark, sf).select("model", "build", "n", ((F.col("top1_differs") == 0) & (F.col("largest_difference") < 1e-3)).alias("same_answers"), (F.col("unpaired") == 0).alias("same_items"))


NINE = ("clean", "demo/fade/3", "demo/jitter/5")


def extra_rows(spark: SparkSession, sf: str, models: int = 3) -> DataFrame:
    """Extra gaps with intervals per model and condition, with the reference's top-1 there."""
    df = outcomes_fast(spark, sf, models, ["clean", "demo/fade/5", "demo/jitter/3"])
    ref = df.filter("build = 'ref'").groupBy("model", "cond_id").agg(F.avg("correct").alias("ref"))
    return difference_ci(extra_gaps(df), ["model", "cond_id"], B).join(ref, ["model", "cond_id"])


def q_large_extra(spark: SparkSession, sf: str) -> DataFrame:
    rows = extra_rows(spark, sf).withColumns({"judged": F.col("ref") >= 0.10, "holds": R.large_extra_gap(F.col("count"), F.col("n"), F.col("hi"))})
    return R.count_verdict(rows, 2, ["cond_id"])


def q_cond_vs_cond(spark: SparkSession, sf: str) -> DataFrame:
    df = outcomes_fast(spark, sf, 3, ["clean", "demo/fade/5", "demo/jitter/3"])
    own = extra_gaps(df)
    both = own.filter("cond_id = 'demo/fade/5'").select("model", "item", F.col("x").alias("xa")).join(own.filter("cond_id = 'demo/jitter/3'").select("model", "item", F.col("x").alias("xb")), ["model", "item"])
    diff = difference_ci(both.withColumn("x", F.col("xa") - F.col("xb")), ["model"], B)
    floor = df.filter("build = 'ref'").groupBy("model", "cond_id").agg(F.avg("correct").alias("ref")).groupBy("model").agg(F.min("ref").alias("ref"))
    rows = diff.join(floor, "model").withColumns({"judged": F.col("ref") >= 0.10, "holds": (F.col("count") < 0) & (F.col("side") == "below zero")})
    return R.count_verdict(rows, 2)


def q_correlations(spark: SparkSession, sf: str) -> DataFrame:
    t = tops(spark, sf, conds=NINE).filter("cond_id <> 'clean'").withColumn("clean_gap", r9(F.col("gap") - F.col("extra")))
    pairs = {"clean reference and shrunk": ("ref0", "small"), "clean reference and gap": ("ref0", "gap"), "clean gap and gap": ("clean_gap", "gap")}
    out = None
    for name, (x, y) in pairs.items():
        own = stat_corr_judged(t, ["cond_id"], x, y, "ref").withColumn("pair", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def q_without_models(spark: SparkSession, sf: str) -> DataFrame:
    own = tops(spark, sf, conds=NINE)
    rest = stat_spearman(own.filter("model not in ('m7', 'm8')"), ["cond_id"], "ref0", "gap")
    return stat_spearman(own, ["cond_id"], "ref0", "gap").join(rest.select("cond_id", F.col("rho").alias("rho_without"), F.col("models").alias("models_without")), "cond_id")


QUERIES = {
    "cmp_envelope": lambda s, d: damaged(s, d).select(*CELL, "top1", "drop", "drop_lo", "drop_hi", "cost", "cost_lo", "cost_hi", "coverage", "cov_lo", "cov_hi", "state", "flags"),
    "cmp_damage_drop": lambda s, d: damaged(s, d).select(*CELL, "n", "drop", "drop_lo", "drop_hi"),
    "cmp_shrinking_cost": lambda s, d: judged(s, d).filter("build = 'small'").select("model", "cond_id", "n", "cost", "cost_lo", "cost_hi"),
    "cmp_vs_reference_rows": lambda s, d: judged(s, d).select("model", "build", "cond_id", "top1", F.when(F.col("build") != "ref", F.col("cost")).alias("change"), F.when(F.col("build") == "ref", 0).otherwise(1).alias("precision_rank")),
    "cmp_harm_counts": lambda s, d: harm_counts(damaged(s, d)),
    "cmp_cause_counts": lambda s, d: cause_counts(caused(s, d)),
    "cmp_summary_counts": lambda s, d: summary_counts(caused(s, d)).toDF("model", "not_harmful", "borderline", "too_hard", "hurt", "unclear").na.fill(0),
    "cmp_closest_to_line": lambda s, d: closest_to_line(damaged(s, d)),
    "cmp_borderline_rows": lambda s, d: damaged(s, d).filter("state = 'borderline'").select(*CELL, "reasons"),
    "cmp_heat_step": lambda s, d: judged(s, d).filter("build = 'small'").select("model", "cond_id", "cost", F.when(F.col("near_floor"), -1).otherwise(heat_step()).alias("step")),
    "cmp_series": q_series,
    "cmp_reproduction": q_reproduction,
    "cmp_clean_check": q_clean_check,
    "cmp_breadth_table": lambda s, d: breadth_table(tops(s, d, conds=NINE)),
    "cmp_condition_groups": lambda s, d: tops(s, d, conds=NINE).filter("cond_id <> 'clean'").groupBy(F.when(F.col("cond_id").rlike("fade"), "fade").otherwise("jitter").alias("kind")).agg(F.count("*").alias("pairs"), F.count_if((F.col("ref") >= 0.10) & (F.col("extra") <= -0.05)).alias("flagged"), F.min(F.when(F.col("ref") >= 0.10, F.col("extra"))).alias("worst")),
    "cmp_median_extra_gap": lambda s, d: tops(s, d, conds=NINE).filter("cond_id <> 'clean'").groupBy("cond_id").agg(r9(F.median("extra")).alias("median_extra")).withColumn("past_line", F.col("median_extra") <= -0.05),
    "cmp_condition_hits": lambda s, d: tops(s, d, conds=NINE).filter("cond_id <> 'clean' and extra <= -0.05").groupBy("cond_id").agg(F.count("*").alias("models"), F.array_join(F.array_except(F.array_sort(F.collect_set("model")), F.array(F.lit("m0"), F.lit("m1"))), ",").alias("beyond")),
    "cmp_without_models": q_without_models,
    "rule_envelope": lambda s, d: damaged(s, d).select(*CELL, "state", "reasons"),
    "rule_failed_lines": lambda s, d: damaged(s, d).select(*CELL, "failed_lines"),
    "rule_line_states": lambda s, d: damaged(s, d).select(*CELL, "drop_state", "cov_state"),
    "rule_cost_flags": lambda s, d: damaged(s, d).filter("build = 'small'").select(*CELL, "flags"),
    "rule_harm_cause": lambda s, d: caused(s, d).select("model", "cond_id", "state", "cause"),
    "rule_label_summary": lambda s, d: label_summary(caused(s, d)),
    "rule_next_step": lambda s, d: caused(s, d).select("model", "cond_id", "next_step"),
    "rule_cost_verdict": lambda s, d: judged(s, d).filter("build = 'small'").select("model", "cond_id", "cost_verdict"),
    "rule_near_floor": lambda s, d: judged(s, d).select("model", "build", "cond_id", "near_floor"),
    "rule_large_extra_gap": q_large_extra,
    "rule_cond_vs_cond": q_cond_vs_cond,
    "rule_correlations": q_correlations,
    "rule_count_verdict": lambda s, d: R.count_verdict(damaged(s, d).select("build", (~F.col("near_floor")).alias("judged"), (F.col("state") == "harmful").alias("holds")), 2, ["build"]),
    "rule_all_parts": lambda s, d: damaged(s, d).select(*CELL, R.all_parts(F.create_map(F.lit("coverage"), F.col("cov_state") == "copes", F.lit("drop"), F.col("drop_state") == "copes")).alias("verdict")),
    "rule_three_way": lambda s, d: damaged(s, d).groupBy("build").agg(F.count_if(F.col("state") == "not harmful").alias("supporting"), F.count_if(F.col("state") == "harmful").alias("rejecting"), F.count("*").alias("n")).withColumn("verdict", R.three_way(F.col("supporting"), F.col("rejecting"), F.col("n"), 2)),
    "rule_band": lambda s, d: judged(s, d).filter("build = 'small'").select("model", "cond_id", R.band(F.col("cost_lo"), F.col("cost_hi")).alias("band")),
}

_C = "model, build, cond_id"
_FACTS = f"""fx as materialized (select s.model, s.build, s.cond_id, s.item, s.correct, s.covered, s.size, s.correct - c.correct d, s.correct - r.correct k, r.correct rc from sets s
  join sets c on c.model = s.model and c.build = s.build and c.item = s.item and c.cond_id = 'clean' join sets r on r.model = s.model and r.cond_id = s.cond_id and r.item = s.item and r.build = 'ref'),
pt as (select {_C}, count(*) n, round(avg(correct), 9) top1, round(avg(covered), 9) coverage, round(avg(size), 9) mean_size, round(avg(d), 9) as drop_, round(avg(k), 9) as cost, round(avg(rc), 9) ref_top1 from fx group by all),
bt as (select {_C}, b, sum(w * covered) / sum(w) cv, sum(w * d) / sum(w) dv, sum(w * k) / sum(w) kv from fx join weights using (item) group by all),
ci as (select {_C}, {', '.join(f"round(quantile_cont({v}, {p}::double), 9) {n}" for v, x in (("cv", "cov"), ("dv", "drop"), ("kv", "cost")) for p, n in ((0.025, x + "_lo"), (0.975, x + "_hi")))} from bt group by all),
states as (select *, case when drop_hi < -0.10::double then 'fails' when drop_lo >= -0.10::double then 'copes' else 'straddles' end drop_state, case when cov_hi < 0.80::double then 'fails' when cov_lo >= 0.80::double then 'copes' else 'straddles' end cov_state from pt join ci using ({_C})),
judged as materialized (select *, case when drop_state = 'fails' or cov_state = 'fails' then 'harmful' when drop_state = 'copes' and cov_state = 'copes' then 'not harmful' else 'borderline' end state,
  concat_ws('; ', case when drop_state = 'fails' then 'damage drop' end, case when cov_state = 'fails' then 'coverage' end) failed_lines,
  concat_ws('; ', case when cost_hi < -0.05::double then 'large shrinking cost' end, case when ref_top1 < 0.10::double then 'not informative' end) flags, ref_top1 < 0.10::double near_floor from states),
damaged as (select * from judged where cond_id <> 'clean'),
caused as (select s.*, r.state ref_state, r.drop_state ref_drop, r.cov_state ref_cov, r.failed_lines ref_failed, case when s.state = 'harmful' then case r.state when 'harmful' then 'too hard for this model' when 'not harmful' then 'hurt by shrinking' else 'cause unclear' end end cause from damaged s left join damaged r on r.model = s.model and r.cond_id = s.cond_id and r.build = 'ref' where s.build = 'small')"""
_REASONS = """case when state = 'harmful' then concat_ws('; ', case when drop_state = 'fails' then 'damage drop: all of the interval is under the line' end, case when cov_state = 'fails' then 'coverage: all of the interval is under the line' end)
 when state = 'not harmful' then 'no part of either interval is under its line'
 else concat_ws('; ', case when cov_state = 'straddles' then 'coverage: the line is inside the interval' end, case when drop_state = 'straddles' then 'damage drop: the line is inside the interval' end) end reasons"""
_STEP = """case when state <> 'harmful' then '-' else concat_ws('; ', case when drop_state = 'fails' then case ref_drop when 'fails' then 'use a stronger model' when 'copes' then 'try another recipe' else 'test with more items' end end,
 case when cov_state = 'fails' then 'recalibrate on damaged data' end, case when cov_state = 'fails' and ref_cov = 'copes' and not (drop_state = 'fails' and ref_drop = 'copes') then 'try another recipe' end) end next_step"""


def _f(sql: str) -> str:
    return duck(sql, "sets", "weights", more=_FACTS, b=B)


def _dist(p: str, line: float) -> str:
    return f"case when {p}_lo >= {line}::double then {p}_lo - {line}::double when {p}_hi < {line}::double then {p}_hi - ({line}::double) else 0.0::double end".replace("- -", "+ ")


def _t(sql: str) -> str:
    return duck(sql, "scores", more=_TOPS, **_NINE)


_COUNTS = "count(*) n, count(*) filter (state = 'not harmful') not_harmful, count(*) filter (state = 'borderline') borderline, count(*) filter (state = 'harmful') harmful, count(*) filter (failed_lines = 'damage drop') accuracy_only, count(*) filter (failed_lines = 'coverage') coverage_only, count(*) filter (failed_lines = 'damage drop; coverage') both_lines"
_THREE = {"models": 3, "conds": ["clean", "demo/fade/5", "demo/jitter/3"], "b": B}
_XROWS = f"""{_FAST}, {_GAP}, refs as (select model, cond_id, avg(correct) ref from fast where build = 'ref' group by 1, 2)"""
_REPRO = """pairs as (select coalesce(a.model, b.model) model, coalesce(a.build, b.build) build, coalesce(a.cond_id, b.cond_id) cond_id, a.z za, b.z zb from scores a full join
 (select * replace (list_transform(z, lambda x: case when item % 97 = 0 then x + 0.001::double else x end) as z) from scores where item % 1009 <> 0) b on a.model = b.model and a.build = b.build and a.cond_id = b.cond_id and a.item = b.item),
repro as (select model, build, cond_id, count(*) filter (za is null or zb is null) unpaired, count(*) n, count(*) filter (list_position(za, list_max(za)) <> list_position(zb, list_max(zb))) top1_differs, count(*) filter (g = 0) as identical, round(max(g), 9) largest_difference from (select *, case when zb is not null and za is not null then list_max(list_transform(za, lambda x, i: abs(x - zb[i]))) end g from pairs) group by all)"""
_CORR = " union all ".join(
    f"select cond_id, coalesce(models, 0) models, near_floor, case when models >= 6 then rho end rho, case when coalesce(models, 0) < 6 then 'too few models' when rho is null then 'constant' else 'judged' end reason, '{n}' pair from (select cond_id, count(*) filter (ref < 0.1::double) near_floor from t group by 1) left join (select cond_id, count(*) models, {_RHO} rho from (select cond_id, {_rank(x, 'cond_id')} rx, {_rank(y, 'cond_id')} ry from t where ref >= 0.1::double) group by 1) using (cond_id)"
    for n, x, y in (("clean reference and shrunk", "ref0", "small"), ("clean reference and gap", "ref0", "gap"), ("clean gap and gap", "clean_gap", "gap"))
)
_VERDICT = "count(*) filter (j and h) holding, count(*) filter (j) judged, count(*) total, case when count(*) filter (j and h) >= 2 then 'PASS' else 'FAIL' end verdict"
ORACLE = {
    "cmp_envelope": _f(f"select {_C}, top1, drop_ as drop, drop_lo, drop_hi, cost, cost_lo, cost_hi, coverage, cov_lo, cov_hi, state, flags from damaged"),
    "cmp_damage_drop": _f(f"select {_C}, n, drop_ as drop, drop_lo, drop_hi from damaged"),
    "cmp_shrinking_cost": _f("select model, cond_id, n, cost, cost_lo, cost_hi from judged where build = 'small'"),
    "cmp_vs_reference_rows": _f(f"select {_C}, top1, case when build <> 'ref' then cost end change, case when build = 'ref' then 0 else 1 end precision_rank from judged"),
    "cmp_harm_counts": _f(f"select coalesce(model, 'all models') model, build, {_COUNTS} from damaged group by grouping sets ((model, build), (build))"),
    "cmp_cause_counts": _f("select model, count(*) too_hard, count(*) filter (ref_failed = 'damage drop') ref_accuracy_only, count(*) filter (ref_failed = 'coverage') ref_coverage_only, count(*) filter (ref_failed = 'damage drop; coverage') ref_both from caused where cause = 'too hard for this model' group by 1"),
    "cmp_summary_counts": _f("select model, count(*) filter (state = 'not harmful') not_harmful, count(*) filter (state = 'borderline') borderline, count(*) filter (cause = 'too hard for this model') too_hard, count(*) filter (cause = 'hurt by shrinking') hurt, count(*) filter (cause = 'cause unclear') unclear from caused group by 1"),
    "cmp_closest_to_line": _f(f"select model, build, metric, cond_id, round(d, 9) distance from (select *, row_number() over (partition by model, build, metric order by abs(d), cond_id) rn from (select {_C}, 'coverage' metric, {_dist('cov', 0.80)} d from damaged union all select {_C}, 'damage drop', {_dist('drop', -0.10)} from damaged)) where rn = 1"),
    "cmp_borderline_rows": _f(f"select {_C}, {_REASONS} from damaged where state = 'borderline'"),
    "cmp_heat_step": _f("select model, cond_id, cost, case when near_floor then -1 when -cost <= 0 then 0 else 1 + (round(-cost, 9) >= 0.01::double)::int + (round(-cost, 9) >= 0.05::double)::int + (round(-cost, 9) >= 0.15::double)::int end step from judged where build = 'small'"),
    "cmp_series": duck("select t.model, t.build, k.corruption, max(top1) filter (t.cond_id = 'clean') s0, max(top1) filter (c.corruption = k.corruption and severity = 1) s1, max(top1) filter (c.corruption = k.corruption and severity = 3) s3, max(top1) filter (c.corruption = k.corruption and severity = 5) s5 from (select model, build, cond_id, round(avg(correct), 9) top1 from fast group by all) t join conditions c using (cond_id) cross join (select distinct corruption from conditions where severity > 0) k group by 1, 2, 3", "scores", "conditions", more=_FAST),
    "cmp_reproduction": duck("select *, unpaired = 0 and top1_differs <= n // 1000 ok from repro", "scores", more=_REPRO, conds=["clean"]),
    "cmp_clean_check": duck("select model, build, n, top1_differs = 0 and largest_difference < 1e-3::double same_answers, unpaired = 0 same_items from repro", "scores", more=_REPRO, conds=["clean"]),
    "cmp_breadth_table": _t("select model, cond_id, ref, round(ref - ref0, 9) minus_clean, ref < 0.10::double near_floor, small, gap, round(small / nullif(ref, 0), 9) ratio, extra from tops"),
    "cmp_condition_groups": _t("select case when cond_id like '%fade%' then 'fade' else 'jitter' end kind, count(*) pairs, count(*) filter (ref >= 0.10::double and extra <= -0.05::double) flagged, min(extra) filter (ref >= 0.10::double) worst from tops where cond_id <> 'clean' group by 1"),
    "cmp_median_extra_gap": _t("select cond_id, round(median(extra), 9) median_extra, round(median(extra), 9) <= -0.05::double past_line from tops where cond_id <> 'clean' group by 1"),
    "cmp_condition_hits": _t("select cond_id, count(*) models, coalesce(string_agg(model, ',' order by model) filter (model not in ('m0', 'm1')), '') beyond from tops where cond_id <> 'clean' and extra <= -0.05::double group by 1"),
    "cmp_without_models": _t(f"select * from (select cond_id, count(*) models, {_RHO} rho from (select cond_id, {_rank('ref0', 'cond_id')} rx, {_rank('gap', 'cond_id')} ry from tops) group by 1) join (select cond_id, {_RHO} rho_without, count(*) models_without from (select cond_id, {_rank('ref0', 'cond_id')} rx, {_rank('gap', 'cond_id')} ry from tops where model not in ('m7', 'm8')) group by 1) using (cond_id)"),
    "rule_envelope": _f(f"select {_C}, state, {_REASONS} from damaged"),
    "rule_failed_lines": _f(f"select {_C}, failed_lines from damaged"),
    "rule_line_states": _f(f"select {_C}, drop_state, cov_state from damaged"),
    "rule_cost_flags": _f(f"select {_C}, flags from damaged where build = 'small'"),
    "rule_harm_cause": _f("select model, cond_id, state, cause from caused"),
    "rule_label_summary": _f("select model, state, cause, count(*) n, string_agg(cond_id, ',' order by cond_id) conditions, count(*) filter (failed_lines = 'damage drop') accuracy_only, count(*) filter (failed_lines = 'coverage') coverage_only, count(*) filter (failed_lines = 'damage drop; coverage') both_lines from caused group by 1, 2, 3"),
    "rule_next_step": _f(f"select model, cond_id, {_STEP} from caused"),
    "rule_cost_verdict": _f("select model, cond_id, case when cost_hi < -0.05::double then 'large' when cost_lo > -0.05::double then 'small' else 'too close to call' end cost_verdict from judged where build = 'small'"),
    "rule_near_floor": _f(f"select {_C}, near_floor from judged"),
    "rule_large_extra_gap": duck(f"select cond_id, {_VERDICT} from (select cond_id, ref >= 0.10::double j, c * 100 <= -5 * n and hi < 0 h from (select model, cond_id, count(*) n, sum(x)::bigint c from extra group by all) join (select model, cond_id, {_Q} from (select model, cond_id, b, sum(w * x) / sum(w) v from extra join weights using (item) group by all) group by all) using (model, cond_id) join refs using (model, cond_id)) group by 1", "scores", "weights", more=_XROWS, **_THREE),
    "rule_cond_vs_cond": duck(f"select {_VERDICT} from (select ref >= 0.10::double j, c < 0 and hi < 0 h from (select model, sum(x)::bigint c from pairs group by all) join (select model, {_Q} from (select model, b, sum(w * x) / sum(w) v from pairs join weights using (item) group by all) group by all) using (model) join (select model, min(ref) ref from refs group by 1) using (model))", "scores", "weights", more=f"{_XROWS}, pairs as materialized (select a.model, a.item, a.x - b.x x from extra a join extra b using (model, item) where a.cond_id = 'demo/fade/5' and b.cond_id = 'demo/jitter/3')", **_THREE),
    "rule_correlations": duck(_CORR, "scores", more=f"{_TOPS}, t as (select *, round(gap - extra, 9) clean_gap from tops where cond_id <> 'clean')", **_NINE),
    "rule_count_verdict": _f(f"select build, {_VERDICT} from (select build, not near_floor j, state = 'harmful' h from damaged) group by 1"),
    "rule_all_parts": _f(f"select {_C}, case when cov_state = 'copes' and drop_state = 'copes' then 'PASS' else 'FAIL' end verdict from damaged"),
    "rule_three_way": _f("select *, case when supporting >= 2 then 'SUPPORTS' when rejecting >= n // 2 + 1 then 'REJECTS' else 'INCONCLUSIVE' end verdict from (select build, count(*) filter (state = 'not harmful') supporting, count(*) filter (state = 'harmful') rejecting, count(*) n from damaged group by 1)"),
    "rule_band": _f("select model, cond_id, case when cost_lo >= -0.05::double and cost_hi <= 0.05::double then 'supports' when cost_hi < -0.05::double then 'rejects' else 'neither' end band from judged where build = 'small'"),
}
