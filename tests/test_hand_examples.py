"""Hand-computed answers and boundary cases of the evaluation operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scoring as S
from plumbline.operators import alarm, damage, latency, metrics, outcomes, quality, quantise, resample, rules, splits, text_checks

CELL = ("m0", "ref", "clean")


def rows(spark, confidence, correct):
    data = [(*CELL, i, float(c), float(k)) for i, (c, k) in enumerate(zip(confidence, correct, strict=True))]
    return spark.createDataFrame(data, "model string, build string, cond_id string, item long, confidence double, correct double")


def scored(spark, z, labels):
    data = [(*CELL, "test", i, k, [float(x) for x in v]) for i, (v, k) in enumerate(zip(z, labels, strict=True))]
    return spark.createDataFrame(data, "model string, build string, cond_id string, split string, item long, label int, z array<double>")


def test_risk_curve(spark):
    got = metrics.m_risk_curve(rows(spark, [0.7, 0.9, 0.6, 0.8], [1, 1, 0, 0])).orderBy("k").collect()
    assert [round(r.risk, 6) for r in got] == [0.0, 0.5, round(1 / 3, 6), 0.5]


def test_risk_curve_all_tied_is_flat(spark):
    got = metrics.m_risk_curve(rows(spark, [0.5] * 5, [1, 0, 1, 0, 1])).collect()
    assert {round(r.risk, 9) for r in got} == {0.4}


def test_aurc_closed_form_equals_the_curve(spark):
    rng = np.random.default_rng(0)
    confidence, correct = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    df = rows(spark, confidence, correct)
    curve = [r.risk for r in metrics.m_risk_curve(df).collect()]
    got = metrics.m_aurc_all(df).first()
    assert abs(got.aurc - sum(curve) / 300) < 1e-8
    best = metrics.m_risk_curve(rows(spark, correct + 0.0, correct)).collect()
    order = sorted(best, key=lambda r: r.k)
    wrong = np.cumsum(np.sort(1 - correct))
    assert abs(got.optimal - np.mean(wrong / np.arange(1, 301))) < 1e-8 and len(order) == 300
    assert abs(got.e_aurc - (got.aurc - got.optimal)) < 1e-8


def test_harmonic_numbers(spark):
    ns = [0, 1, 2, 40, 41, 1000]
    got = [r.h for r in spark.createDataFrame([(n,) for n in ns], "n long").select(metrics.harmonic(F.col("n")).alias("h")).collect()]
    assert np.allclose(got, [sum(1 / i for i in range(1, n + 1)) for n in ns], atol=1e-12)


def test_risk_index_rounds_half_to_even(spark):
    got = {r.coverage: r.k for r in metrics.m_risk_at(rows(spark, [i / 50 for i in range(50)], [1] * 50)).collect()}
    assert got[0.01] == 1 and got[0.05] == 2 and got[0.07] == 4 and got[1.0] == 50


def conformal(spark, p, coverage):
    df = spark.createDataFrame([("k", 0, [float(x)]) for x in p], "k string, label int, p array<double>")
    return outcomes.conformal_threshold(df, ["k"], coverage).first().q


def test_conformal_threshold(spark):
    assert abs(conformal(spark, [0.9, 0.8, 0.6, 0.3], 0.5) - 0.4) < 1e-12
    assert conformal(spark, [0.9] * 5, 0.9) == 1.0
    rng = np.random.default_rng(1)
    p = np.round(rng.random(400), 2)
    k = math.ceil(401 * 0.9)
    assert abs(conformal(spark, p, 0.9) - np.sort(1 - p)[k - 1]) < 1e-12


def test_ties(spark):
    z = [[1, 1, 0], [0, 2, 2], [3, 3, 3]]
    got = metrics.m_tie_range(scored(spark, z, [0, 0, 2])).first()
    assert got.tied == 3 and got.lowest == 0 and abs(got.highest - 2 / 3) < 1e-8
    assert [r.pred for r in outcomes.outcomes(scored(spark, z, [0, 0, 2])).orderBy("item").collect()] == [0, 1, 0]
    ranks = scored(spark, z, [1, 0, 2]).select(S.label_rank(F.col("z"), F.col("label")).alias("r")).collect()
    assert [r.r for r in ranks] == [2, 3, 3]


def test_ece_bins_are_closed_on_the_right(spark):
    edges = [0.0, 1 / 15, 1 / 15 + 1e-9, 1.0]
    got = spark.createDataFrame([(c,) for c in edges], "c double").select(metrics.bin_of(F.col("c")).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 1, 14]


def test_reliability_bins_keep_empty_ones(spark):
    got = metrics.m_reliability_bins(rows(spark, [0.5, 0.95], [1, 0])).collect()
    assert len(got) == 15 and sum(r.n for r in got) == 2 and sum(r.accuracy is None for r in got) == 13


def test_temperature_is_recovered(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(3000, 4)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    labels = [int(rng.choice(4, p=q)) for q in p]
    fit = metrics.m_temperature_fit(scored(spark, (z * 2).tolist(), labels), passes=3).first()
    assert abs(fit.temperature - 2) < 0.15 and not fit.at_end


def test_average_ranks_and_spearman(spark):
    df = spark.createDataFrame([("k", str(i), float(x), float(y)) for i, (x, y) in enumerate([(3, 1), (1, 2), (2, 3), (2, 5)])], "k string, model string, x double, y double")
    got = resample.stat_average_rank(df, ["k"], "x").orderBy("model").collect()
    assert [r["rank"] for r in got] == [4, 1, 2.5, 2.5]
    rho = resample.stat_spearman(df, ["k"], "x", "y").first().rho
    assert abs(rho - np.corrcoef([4, 1, 2.5, 2.5], [1, 2, 3, 4])[0, 1]) < 1e-8
    assert resample.stat_spearman(df.withColumn("x", F.lit(1.0)), ["k"], "x", "y").first().rho is None


def test_bootstrap_weights_agree_and_are_poisson(spark):
    items = spark.range(500).withColumnRenamed("id", "item")
    got = {(r.item, r.b): r.w for r in resample.bs_weights(items, 20).collect()}
    matrix = resample.weight_matrix(np.arange(500), 20, 0)
    assert all(matrix[i, b] == w for (i, b), w in got.items())
    assert abs(matrix.mean() - 1) < 0.05 and abs(matrix.var() - 1) < 0.1


def test_bootstrap_interval_is_near_the_textbook_one(spark):
    rng = np.random.default_rng(3)
    df = rows(spark, [0.5] * 4000, (rng.random(4000) < 0.7).astype(int))
    got = resample.bs_mean_ci(df, list(outcomes.CELL), "correct", 400).first()
    half = 1.96 * math.sqrt(0.7 * 0.3 / 4000)
    assert abs((got.hi - got.lo) / 2 - half) < 0.25 * half


def test_extra_gap_and_the_large_line(spark):
    data = []
    for cond, build, hits in (("clean", "ref", 800), ("clean", "small", 790), ("bad", "ref", 600), ("bad", "small", 520)):
        data += [("m", build, cond, i, 1.0 if i < hits else 0.0) for i in range(1000)]
    df = spark.createDataFrame(data, "model string, build string, cond_id string, item long, correct double")
    assert resample.bs_extra_gap(df, 20).first()["count"] == -70
    line = spark.createDataFrame([(-500, 10_000), (-499, 10_000)], "c long, n long").select(rules.large_extra_gap(F.col("c"), F.col("n"), F.lit(-0.01)).alias("x")).collect()
    assert [r.x for r in line] == [True, False]


def test_unpaired_items_are_found(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "build string, item long")
    got = resample.unpaired_items(df, F.col("build") == "a", F.col("build") == "b", ["item"])
    assert sorted(r.item for r in got.collect()) == [1, 3]


@pytest.mark.parametrize(
    "cov,drop,state,failed",
    [
        ((0.80, 0.90), (-0.10, -0.02), "not harmful", ""),
        ((0.70, 0.7999), (-0.05, 0.0), "harmful", "coverage"),
        ((0.79, 0.85), (-0.05, 0.0), "borderline", ""),
        ((0.70, 0.75), (-0.3, -0.2), "harmful", "damage drop; coverage"),
        ((0.85, 0.90), (-0.3, -0.10), "borderline", ""),
    ],
)
def test_envelope_ends(spark, cov, drop, state, failed):
    fact = spark.createDataFrame([("m", "small", "c", *map(float, (*cov, *drop)), -0.06, -0.0499, 0.10)], "model string, build string, cond_id string, cov_lo double, cov_hi double, drop_lo double, drop_hi double, cost_lo double, cost_hi double, ref_top1 double")
    got = rules.envelope(fact, rules.rules(spark)).first()
    assert (got.state, got.failed_lines, got.flags, got.near_floor, got.cost_verdict) == (state, failed, "", False, "too close to call")


def test_near_floor_flag_and_order(spark):
    fact = spark.createDataFrame([("m", "small", "c", 0.9, 0.95, 0.0, 0.1, -0.2, -0.051, 0.0999)], "model string, build string, cond_id string, cov_lo double, cov_hi double, drop_lo double, drop_hi double, cost_lo double, cost_hi double, ref_top1 double")
    assert rules.envelope(fact, rules.rules(spark)).first().flags == "large shrinking cost; not informative"


def test_band_and_three_way(spark):
    df = spark.createDataFrame([(-0.05, 0.05), (-0.0501, 0.0), (-0.2, -0.05), (-0.2, -0.0501)], "lo double, hi double")
    assert [r.b for r in df.select(rules.band(F.col("lo"), F.col("hi")).alias("b")).collect()] == ["supports", "neither", "neither", "rejects"]
    n = spark.createDataFrame([(6, 0, 8), (5, 5, 8), (5, 4, 8)], "s int, r int, n int")
    assert [r.v for r in n.select(rules.three_way(F.col("s"), F.col("r"), F.col("n")).alias("v")).collect()] == ["SUPPORTS", "REJECTS", "INCONCLUSIVE"]


def test_splits_are_disjoint_and_repeatable(spark):
    items = spark.range(1000).withColumnRenamed("id", "item")
    sizes = {"test": 500, "tuning": 300, "calibration": 100}
    a = {(r.item, r.split) for r in splits.split_make(items, sizes).collect()}
    assert a == {(r.item, r.split) for r in splits.split_make(items.repartition(7), sizes).collect()}
    assert len({i for i, _ in a}) == len(a) == 900
    assert {s: sum(x == s for _, x in a) for s in sizes} == sizes
    with pytest.raises(ValueError):
        splits.split_make(items, {"test": 1001})
    assert splits.split_subset(items, 2000).count() == 1000 and splits.split_subset(items, None).count() == 1000


def test_balanced_plan(spark):
    plan = splits.plan_balanced(spark.range(5000).withColumnRenamed("id", "item")).groupBy("corruption", "severity").count().collect()
    assert [r["count"] for r in plan if r.severity == 0] == [1667]
    pairs = [r["count"] for r in plan if r.severity > 0]
    assert len(pairs) == 20 and set(pairs) == {166, 167}


def test_windows_drop_the_tail_and_fire_strictly_below(spark):
    df = rows(spark, [0.5] * 250, [1] * 250)
    windows = alarm.win_consecutive(df, list(outcomes.CELL))
    assert windows.count() == 2
    limit = spark.createDataFrame([("m0", "ref", 0.5)], "model string, build string, threshold double")
    assert alarm.alarm_fires(windows, limit, list(outcomes.CELL), ["model", "build"]).first().fired == 0


def test_interruption(spark):
    t = lambda gap, long: [("b", 1, i, float(i) + (gap if i > 5 else 0), float(i) + (gap if i > 5 else 0) + (long if i == 3 else 0.01), (long if i == 3 else 0.01) * 1000) for i in range(10)]
    for gap, long, bad in ((0, 0.01, False), (30, 0.01, True), (0, 5.0, True)):
        df = spark.createDataFrame(t(gap, long), "build string, session int, run int, start double, stop double, ms double")
        assert latency.lat_interruption(df).first().discarded is bad


def test_quantisation_rounds_half_to_even_and_clips(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-9.0,), (999.0,)], "x double").withColumns({"scale": F.lit(1.0), "zero": F.lit(0.0)})
    assert [r.q for r in df.select(quantise.level(F.col("x")).alias("q")).collect()] == [0, 2, 2, 0, 255]


def test_entropy_range_ignores_a_far_outlier(spark):
    rng = np.random.default_rng(4)
    data = [(4 * i, [float(x)]) for i, x in enumerate([*rng.uniform(-1, 1, 2000), 100.0])]
    got = quantise.q_range_entropy(spark.createDataFrame(data, "item long, v array<double>")).first()
    assert got.limit < 100


def test_severity_zero_is_untouched_and_damage_repeats(spark):
    df = spark.createDataFrame([(1, [0.0, 0.25, 1.0, 0.5])], "item long, v array<double>")
    grid = damage.cond_grid(spark)
    a, b = (sorted(map(str, damage.cond_fanout(df, grid).collect())) for _ in range(2))
    assert a == b
    assert [r.v for r in damage.cond_fanout(df, grid).filter("severity = 0").collect()] == [[0.0, 0.25, 1.0, 0.5]]
    assert damage.cond_fanout(df, grid).filter("corruption = 'blur' and severity = 1").first().v[0] == pytest.approx(0.5 / 3)


def test_each_broken_rule_is_found_once(spark):
    good = dict(id=1, schema_version=2, kind="accuracy", source="measured", licence="MIT", commit_id="a" * 40, sha="b" * 64, sessions=3)
    schema = "id int, schema_version int, kind string, source string, licence string, commit_id string, sha string, sessions int"
    faults = {"unknown version": {"schema_version": 3}, "unknown kind": {"kind": "x"}, "unknown source": {"source": "x"}, "no licence": {"licence": None}, "commit is not 40 hexadecimal digits": {"commit_id": "a" * 39}, "arrays without a checksum": {"sha": None}, "too few sessions": {"kind": "latency", "sessions": 1}}
    data = [tuple(good.values())] + [tuple((good | f | {"id": i + 2}).values()) for i, f in enumerate(faults.values())]
    got = quality.problems(spark.createDataFrame(data, schema), ["id"], quality.CHECKS["dq_record"]).collect()
    assert {(r.id, r.problem) for r in got} == {(i + 2, n) for i, n in enumerate(faults)}


def test_json_diff_finds_missing_and_changed_leaves(spark):
    old = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": null}')], "id int, doc string")
    new = spark.createDataFrame([(1, '{"a": {"b": [1, 3, 4]}, "c": null}')], "id int, doc string")
    got = {(r.path, r.old, r.new) for r in quality.json_diff(old, new).collect()}
    assert got == {("a.b[1]", "2", "3"), ("a.b[2]", None, "4")}


def test_sentences(spark):
    text = "One here. Two\nwrapped\n- item one\n# Heading\n\nThree?"
    got = spark.createDataFrame([(text,)], "t string").select(text_checks.sentences(F.col("t")).alias("s")).first().s
    assert got == ["One here.", "Two wrapped", "- item one", "# Heading", "Three?"]


def test_positions_over_two_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t" / "a"))
    spark.range(10, 12).coalesce(1).write.parquet(str(tmp_path / "t" / "b"))
    got = text_checks.positions(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "t"))).orderBy("position").collect()
    assert [(r.position, r.id) for r in got] == [(0, 0), (1, 1), (2, 2), (3, 10), (4, 11)]
