"""AURC replicates: no vectors are put in order, and only the ends of runs are looked up."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import resample


def _rows(seed: int, n: int) -> list[tuple]:
    """Long runs, ties of either kind and of both, a share of an error, items that come twice, a cell without errors, one that
    is a tie."""
    rng = np.random.default_rng(seed)
    confidence = np.where(rng.random(n) < 0.5, rng.integers(0, 40, n) / 40, rng.random(n))
    correct = np.where(confidence > 0.9, 1.0, np.where(confidence < 0.1, 0.0, rng.integers(0, 2, n)))
    correct[::17] = 0.25
    rows = [("mn"[i % 2], i // 3, float(c), float(x)) for i, (c, x) in enumerate(zip(confidence, correct, strict=True))]
    return [*rows, *[("o", i, i / 200, 1.0) for i in range(200)], *[("p", 2**40 + i, 0.5, 0.0) for i in range(12)], *[("q", i, 0.5, float(i % 3 == 0)) for i in range(150)]]


def _want(rows: list[tuple], w: dict) -> float:
    s = before = area = 0.0
    for c in sorted({r[2] for r in rows}, reverse=True):
        m = sum(w[r[1]] for r in rows if r[2] == c)
        e = sum(w[r[1]] * (1 - r[3]) for r in rows if r[2] == c)
        area += sum((before + e * j / m) / (s + j) for j in range(1, int(m) + 1))
        s, before = s + m, before + e
    return area / s


@pytest.mark.parametrize("heavy", [12, 2_000])
def test_aurc_equals_brute_force(spark, heavy):
    rows, b = _rows(4, 900), 7
    df = spark.createDataFrame(rows, "model string, item long, confidence double, correct double").repartition(5)
    got = {(r.model, r.b): r.aurc for r in resample.aurc_replicates(df, ["model"], b, heavy=heavy, rows=90).collect()}
    items = sorted({r[1] for r in rows})
    weights = resample.weight_matrix(np.array(items), b, resample.SEED)
    for k in "mnopq":
        for r in range(b):
            assert abs(got[k, r] - _want([x for x in rows if x[0] == k], dict(zip(items, weights[:, r], strict=True)))) < 1e-10


def test_no_vectors_are_put_in_order(spark, monkeypatch):
    """every row carried two arrays through the ranges and the blocks, null but for heavy ties."""
    kinds = []
    own = resample.in_blocks
    monkeypatch.setattr(resample, "in_blocks", lambda df, *a, **k: kinds.extend(x for _, x in df.dtypes) or own(df, *a, **k))
    df = spark.createDataFrame(_rows(5, 300), "model string, item long, confidence double, correct double")
    blocks = resample.aurc_blocks(df, ["model"], 3, heavy=2)
    assert kinds and not any("array" in x for x in kinds)
    assert blocks.filter("item is null").count() == blocks.filter("ties is not null").count() == blocks.filter("size(tie_errors) = 3").count() > 5


def test_tied_nulls_stay_items(spark):
    """A null equals none: heavy ties of a key that is null are walked item by item."""
    rows = [(None, i, 0.5, float(i % 2)) for i in range(40)]
    blocks = resample.aurc_blocks(spark.createDataFrame(rows, "model string, item long, confidence double, correct double"), ["model"], 3, heavy=2)
    assert blocks.filter("item is not null and ties is null").count() == blocks.count() == 40


def test_items_need_a_number(spark):
    df = spark.createDataFrame([("m", None, 0.5, 1.0), ("m", 1, 0.25, 0.0)], "model string, item long, confidence double, correct double")
    with pytest.raises(Exception, match="without a number"):
        resample.aurc_replicates(df, ["model"], 3).agg(F.sum("aurc")).collect()


def test_only_ends_of_runs_are_looked_up():
    """harmonic numbers were formed for every tie and replicate; a run of 1,000 items has two ends, whatever their order."""
    n = 3_000
    wrong = np.repeat([0.0, 1.0, 0.0], n // 3)
    none = pa.chunked_array([pa.array([None], pa.float64())])
    block = resample._Block(pa.chunked_array([np.arange(n)]), pa.chunked_array([np.arange(n) / n]), pa.chunked_array([wrong]), none, [[np.full(5, 70.0)], [np.full(5, 9.0)]], 0, 5, 0)
    assert block.kind.tolist() == [0, 1, 0] and block.first.tolist() == [0, 1000, 2000]
    area, places, errors = block.walked()
    w = resample.weight_matrix(np.arange(n), 5, 0)[::-1]
    assert (places == w.sum(axis=0)).all() and (errors == w[1000:2000].sum(axis=0)).all()
    for r in range(5):
        copies = np.repeat(wrong, w[:, r].astype(int))
        upto = 9 + np.cumsum(copies)
        assert abs(area[r] - (upto / (70 + np.arange(1, len(copies) + 1))).sum()) < 1e-9
