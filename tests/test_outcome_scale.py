"""What queries over the scored data shuffle, spill and write: nothing as long as the scores."""

import numpy as np

from plumbline.operators import compare, metrics, ordered, resample


def test_outcomes_are_not_written(spark):
    """F1 to F24: the outcomes with their arrays were shuffled and written whole."""
    metrics.scored(spark, "/root/testdata/sf0.001")
    kept = [spark.table(t.name) for t in spark.catalog.listTables() if t.name.startswith("kept_")]
    assert kept and not any("array" in kind for t in kept for _, kind in t.dtypes)


def test_running_ties_equal_brute_force(spark, monkeypatch):
    """F1 to F3: ties are added up inside batches and ranges; what is written has no order column."""
    names = []
    own = ordered.written
    monkeypatch.setattr(ordered, "written", lambda s, df, name: names.append((name, df.columns)) or own(s, df, name))
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else None, 0.5 if i % 4 == 0 else float(x), 1, float(i % 5 == 0)) for i, x in enumerate(rng.integers(0, 900, 5000) / 900)]
    df = spark.createDataFrame(rows, "k string, o double, m long, e double").repartition(7)
    got = sorted(((r.k or "", r.s, r.m, r.e, r.before) for r in ordered.running_ties(df, ["k"], "o", {"m": "s", "e": "before"}, True).collect()))
    want = []
    for k in ("a", None):
        s, before = 0, 0.0
        mine = [r for r in rows if r[0] == k]
        for o in sorted({r[1] for r in mine}, reverse=True):
            tie = [r for r in mine if r[1] == o]
            want.append((k or "", s, len(tie), sum(r[3] for r in tie), before))
            s, before = s + len(tie), before + want[-1][3]
    assert got == sorted(want)
    assert "o" not in dict(names)["strips"]
    assert ordered.running_ties(df.limit(0), ["k"], "o", {"m": "s", "e": "before"}).count() == 0


def test_weights_stand_once_for_keys_that_share_items(spark):
    """sums by cell where every cell has the same items, one of them twice, and where no items are shared."""
    rng = np.random.default_rng(7)
    rows = [(k, i, float(x)) for k in ("a", "b", None) for i, x in zip([*range(40), 3], rng.normal(size=41), strict=True)]
    for shift in (0, 1000):  # with shifted items the keys share none
        own = [(k, i + shift * "ab".find(k or "z"), x) for k, i, x in rows]
        df = spark.createDataFrame(own, "k string, item long, x double").coalesce(1)
        got = {(r.k, r.b): (r.sw, r.x) for r in resample.boot_sums(df, ["k"], ["x"], 9, plain=True).collect()}
        for k in ("a", "b", None):
            items, x = np.array([r[1] for r in own if r[0] == k]), np.array([r[2] for r in own if r[0] == k])
            w = np.column_stack([np.ones(len(items)), resample.weight_matrix(items, 9, resample.SEED)])
            assert all(np.allclose(got[k, b - 1], (w[:, b].sum(), w[:, b] @ x)) for b in range(10))


def test_facts_form_sets_and_pairs_in_plain_expressions(spark, monkeypatch):
    """F9 to F23: the sum of the exponentials was added up anew for each class, sizes and pairs walked lambdas row by row."""
    plans = []
    own = compare.boot_sums
    monkeypatch.setattr(compare, "boot_sums", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df, *a, **k))
    compare.facts(metrics.set_rows(spark, "/root/testdata/sf0.001"), 20)
    (plan,) = plans
    assert "collect_list" not in plan and "size(filter(" not in plan
    [shares] = [x for x in plan.splitlines() if " AS p#" in x]
    assert shares.count("[9])") == 1  # the last of the ten that are added up


def test_facts_pair_the_same_items(spark):
    """F9 to F23: cells that lack items, a null answer and two models, against brute force."""
    rng = np.random.default_rng(3)
    rows = [(m, b, c, i, float(rng.integers(2)), float(rng.integers(2)), float(rng.integers(4))) for m in ("m0", "m1") for b in ("ref", "small", "tiny") for c in ("clean", "x", "y") for i in range(300) if rng.random() < 0.8]
    rows[7] = (*rows[7][:4], None, *rows[7][5:])
    df = spark.createDataFrame(rows, "model string, build string, cond_id string, item long, correct double, covered double, size double")
    got = {(r.model, r.build, r.cond_id): r for r in compare.facts(df.filter("correct is not null"), 20).collect()}
    answer = {r[:4]: r[4] for r in rows if r[4] is not None}
    for cell in {r[:3] for r in rows}:
        m, b, c = cell
        both = [r for r in rows if r[:3] == cell and r[4] is not None and (m, b, "clean", r[3]) in answer and (m, "ref", c, r[3]) in answer]
        want = {"n": len(both), "top1": np.mean([r[4] for r in both]), "coverage": np.mean([r[5] for r in both]), "mean_size": np.mean([r[6] for r in both]), "ref_top1": np.mean([answer[m, "ref", c, r[3]] for r in both])}
        want |= {"drop": np.mean([r[4] - answer[m, b, "clean", r[3]] for r in both]), "cost": np.mean([r[4] - answer[m, "ref", c, r[3]] for r in both])}
        assert all(np.isclose(got[cell][k], v) for k, v in want.items())
    assert len(got) == 18
