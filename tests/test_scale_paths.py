"""What must hold at any size: running totals in blocks, weights, replicates, random windows, shared folders."""

import types

import numpy as np
import pytest

from plumbline import shared
from plumbline.operators import alarm, metrics, ordered, resample
from pyspark.sql import functions as F


def test_running_totals_equal_one_window(spark):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", float(x), i, i % 7) for i, x in enumerate(rng.permutation(2000))]
    df = spark.createDataFrame(rows, "k string, o double, i long, m long")
    for down in (False, True):
        got = {(r.k, r.o): r.s for r in ordered.running(df, ["k"], "o", {"m": "s"}, down).collect()}
        for k in "ab":
            total = 0
            for _, o, _, m in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1] if down else r[1]):
                assert got[k, o] == total
                total += m
    blocks = ordered.in_blocks(df, ["k"], "o")
    assert blocks.select("_block").distinct().count() > 2
    assert ordered.running(df.limit(0), ["k"], "o", {"m": "s"}).count() == 0


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [("a" if i % 2 else None, float(x)) for i, x in enumerate(rng.integers(0, 40, 501))] + [("b", 2.5), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {r.k: r.p for r in ordered.percentiles(df, ["k"], "x", shares).collect()}
    assert set(got) == {"a", "b"} | ({None} & set(got))
    assert np.allclose(got["a"], np.percentile([x for k, x in rows if k == "a"], [100 * s for s in shares])) and got["b"] == [2.5] * 5


def test_weights_are_the_same_rows_and_poisson(spark):
    items = [3, 5, 8, -4, 2**40 + 1]
    matrix = resample.weight_matrix(np.array(items), 37, 2)
    rows = resample.bs_weights(spark.createDataFrame([(i,) for i in items], "item long"), 37, 2).collect()
    assert len(rows) == 5 * 37 and all(matrix[items.index(r.item), r.b] == r.w for r in rows)
    big = resample.weight_matrix(np.arange(20_000), 200, 0)
    assert abs(big.mean() - 1) < 0.003 and abs(big.var() - 1) < 0.01
    assert abs(big.mean(axis=0).std() * np.sqrt(20_000) - 1) < 0.15  # replicates vary as independent draws do
    assert abs(np.corrcoef(big[:-1].ravel(), big[1:].ravel())[0, 1]) < 0.005 and abs(np.corrcoef(big[:, :-1].ravel(), big[:, 1:].ravel())[0, 1]) < 0.005


def test_a_users_metric_and_the_registry(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([("k" if i % 2 else None, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "key string, item long, x double, y double")
    ratio = resample.Metric({"p": F.col("x") * F.col("y"), "q": F.col("x") ** 2}, F.col("p") / F.col("q"))
    got = {(r.key, r.b): r.value for r in resample.replicates(df, ["key"], ratio, 25).collect()}
    w = resample.weight_matrix(np.arange(300), 25, resample.SEED)
    for key, own in ((None, np.arange(0, 300, 2)), ("k", np.arange(1, 300, 2))):
        want = (w[own] * (x * y)[own, None]).sum(0) / (w[own] * (x**2)[own, None]).sum(0)
        assert np.allclose([got[key, b] for b in range(25)], want)
    scored = df.filter("key is not null").selectExpr("key", "item", "cast(item % 3 = 0 as double) as correct", "0.5D as confidence")
    assert set(resample.METRICS) >= {"accuracy", "ece", "overconfidence"}
    for name in resample.METRICS:
        row = resample.bootstrap(scored, ["key"], name, 50).first()
        assert row.lo <= row.hi


def test_aurc_replicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [("m", "ref", "clean", i, float(c), float(rng.random() < 0.7)) for i, c in enumerate(rng.integers(0, 60, 240) / 60)]
    df = spark.createDataFrame(rows, "model string, build string, cond_id string, item long, confidence double, correct double")
    got = {r.b: r for r in resample.aurc_replicates(df, ["model", "build", "cond_id"], 6).collect()}
    w = resample.weight_matrix(np.arange(240), 6, resample.SEED)
    for b in range(6):
        groups = {}
        for _, _, _, i, c, right in rows:
            m, e = groups.get(c, (0, 0))
            groups[c] = m + w[i, b], e + w[i, b] * (1 - right)
        s = before = area = 0.0
        for c in sorted(groups, reverse=True):
            m, e = groups[c]
            area += sum((before + e * j / m) / (s + j) for j in range(1, int(m) + 1))
            s, before = s + m, before + e
        best = sum(max(0, k - (s - before)) / k for k in range(1, int(s) + 1)) / s
        assert abs(got[b].aurc - area / s) < 1e-9 and abs(got[b].e_aurc - (area / s - best)) < 1e-9


def test_aurc_of_heavy_ties_in_bounded_blocks(spark):
    """A third of the items has one confidence, more have a few others: groups in Python stay below the limits."""
    rng, n, b = np.random.default_rng(8), 3_000, 5
    confidence = np.where(np.arange(n) % 3 == 0, 0.75, rng.integers(0, 900, n) / 900)
    confidence[1::30] = 0.5
    wrong = (rng.random(n) < 0.3).astype(float)
    rows = [("m" if i % 2 else "n", i, float(c), float(1 - w)) for i, (c, w) in enumerate(zip(confidence, wrong, strict=True))]
    df = spark.createDataFrame(rows, "model string, item long, confidence double, correct double")
    blocks = resample.aurc_blocks(df, ["model"], b, heavy=20, rows=100)
    sizes = blocks.groupBy("model", "_block").agg(F.count("*").alias("n"), F.count("ties").alias("tied"))
    largest = sizes.agg(F.max("n"), F.sum("tied"), F.sum("n"), F.countDistinct("_block")).first()
    assert largest[0] < 120 and largest[1] >= 3 and largest[2] < n - 900 and largest[3] > 10
    got = {(r.model, r.b): (r.aurc, r.e_aurc) for r in resample.aurc_replicates(df, ["model"], b, heavy=20, rows=100).collect()}
    plain = {(r.model, r.b): (r.aurc, r.e_aurc) for r in resample.aurc_replicates(df, ["model"], b).collect()}
    assert set(got) == set(plain) and len(got) == 2 * b
    assert all(np.allclose(got[k], plain[k], atol=1e-12) for k in got)


def test_blocks_end_with_whole_ties(spark):
    rng = np.random.default_rng(9)
    rows = [("a" if i % 5 else None, float(x), i % 4 + 1) for i, x in enumerate(rng.integers(0, 300, 4000))]
    df = spark.createDataFrame(rows, "k string, o double, size int")
    for size in (None, "size"):
        own = ordered.in_blocks(df, ["k"], "o", rows=50, size=size).collect()
        held = {}
        for r in own:
            held.setdefault(r._block, []).append(r)
        assert len(own) == 4000 and max(sum(r.size if size else 1 for r in v) for v in held.values()) < 50 + 60 * (3 if size else 1)
        ties = {}
        for r in own:
            ties.setdefault((r.k, r.o), set()).add(r._block)
        assert all(len(v) == 1 for v in ties.values())
        for k in ("a", None):
            order = sorted((r._block, r.o) for r in own if r.k == k)
            assert [o for _, o in order] == sorted(o for _, o in order)


def test_running_totals_of_nulls_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    rng = np.random.default_rng(10)
    rows = [(None if i % 3 else "b", i, float(x), None if i % 11 == 0 else i % 7) for i, x in enumerate(rng.permutation(3000))]
    df = spark.createDataFrame(rows, "k string, i int, o double, m int")
    ranges = ordered.in_ranges(df, ["k"], "o", rows=100)
    assert ranges.rdd.getNumPartitions() == 30
    got = {r.i: (r.s, r.t) for r in ordered.running(df, ["k"], "o", {"m": "s", "o": "t"}).collect()}
    for k in (None, "b"):
        s = t = 0
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            assert got[r[1]] == (s, t)
            s, t = s + (r[3] or 0), t + r[2]


def test_random_windows_hold_different_items(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 12 else 0.0) for i in range(30)], "item long, confidence double")
    for n in (12, 30):
        means = [r.mean for r in alarm.win_random(df, [], n=n, windows=500).collect()]
        assert len(means) == 500 and abs(np.mean(means) - 0.4) < 0.02
        if n == 30:  # all items, none twice
            assert set(means) == {0.4}
    assert alarm.win_random(df, [], n=31).count() == 0


def test_correlations_fail_without_valid_draws(spark):
    df = spark.createDataFrame([(f"m{i}", 1.0, float(i)) for i in range(5)], "model string, x double, y double")
    with pytest.raises(ValueError, match="are needed"):
        resample.bs_corr_ci(df, "x", "y", b=5, most=2)
    fine = df.withColumn("x", F.col("y") ** 2)
    assert resample.bs_corr_ci(fine, "x", "y", b=40).first().replicates == 40


def test_temperature_ends_within_the_tolerance(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(400, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    labels = [int(rng.choice(3, p=x)) for x in p]
    df = spark.createDataFrame([("m", "ref", row.tolist(), y) for row, y in zip(z * 1.7, labels, strict=True)], "model string, build string, z array<double>, label int")

    def nll(t):
        own = z * 1.7 / t
        return np.mean(np.log(np.exp(own).sum(axis=1)) - own[np.arange(400), labels])

    grid = np.exp(np.arange(np.log(0.5), np.log(6), 5e-5))
    best = grid[int(np.argmin([nll(t) for t in grid[::20]])) * 20]
    fine = np.exp(np.log(best) + np.arange(-1500, 1500) * 1e-6)
    best = fine[int(np.argmin([nll(t) for t in fine]))]
    assert abs(np.log(metrics.m_temperature_fit(df).first().temperature) - np.log(best)) < 2e-4


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda k, d=None: d)
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="x")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_written_tables_can_be_removed(spark, tmp_path):
    from pathlib import Path

    shared.written(spark, spark.range(3), "three")
    folder = shared.shared_path(spark, "elsewhere")
    spark.range(2).write.parquet(folder)
    assert Path(folder.removeprefix("file:")).exists()
    shared.clear(spark, folder)
    assert not Path(folder.removeprefix("file:")).exists()


def test_harmonics():
    for n in (0, 1, 2, 39, 40, 41, 500):
        want = sum(1 / k for k in range(1, n + 1))
        assert abs(resample._harmonics(np.array([float(n)]))[0] - want) < 1e-12
    assert alarm.attempts(1000, 100) > 100


def test_pairing_by_item_takes_no_exchange(spark):
    """Outcomes are kept by item; what is left to shuffle are sums of cells and replicates."""
    own = metrics.scored(spark, "/root/testdata/sf0.001")
    assert metrics.scored(spark, "/root/testdata/sf0.001").count() == own.count() > 1000
    item_sums = [own.groupBy("model", "cond_id", "item").count(), resample.extra_gaps(own), metrics.m_agreement(own)]
    for df in item_sums:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "item" not in "".join(line for line in plan.splitlines() if "Exchange" in line), plan
