"""Queries over the top-1 of many cells count each item once, without its scores as rows."""

import pytest
from pyspark.sql import functions as F

from plumbline import fixtures, registry
from plumbline.operators import resample


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Keys that are null, negative, large and repeated."""
    folder = str(tmp_path_factory.mktemp("sf"))
    keys = [None, None, -7, 0, 2**40 + 3, 5, 5, *range(10, 400)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").repartition(3).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_hits_equal_the_best_classes_of_scores(spark, sf):
    got = {(r.model, r.build, r.cond_id): (r.n, r.hits) for r in fixtures.hits(spark, sf, 3).collect()}
    rows = resample.outcomes_fast(spark, sf, 3, None).groupBy("model", "build", "cond_id").agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("hits"))
    assert got == {(r.model, r.build, r.cond_id): (r.n, r.hits) for r in rows.collect()} and len(got) == 36
    assert {n for n, _ in got.values()} == {397}


def test_hits_of_no_items(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/orders.parquet").limit(0).write.parquet(f"{tmp_path}/orders.parquet")
    assert fixtures.hits(spark, str(tmp_path), 2).count() == 0


def test_cmp_without_models_reads_items_once(spark, sf):
    """F1: scores were formed four times, for both correlations and for the clean cells of each."""
    plan = registry.queries()["cmp_without_models"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "md5" not in plan


def test_stat_corr_judged_reads_items_once(spark, sf):
    """scores were formed three times, for the counts of models, their correlation and the clean cells."""
    got = registry.queries()["stat_corr_judged"](spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "md5" not in plan
    means = resample.outcomes_fast(spark, sf, 9, ["clean", "demo/fade/3", "demo/jitter/5"]).groupBy("cond_id", "model").pivot("build", ["ref", "small"]).agg(F.avg("correct")).toPandas()
    clean = means[means.cond_id == "clean"].set_index("model")
    want = {}
    for cond, own in means.groupby("cond_id"):
        own = own.set_index("model")
        near = (own.ref < 0.1).sum()
        own = own[own.ref >= 0.1]
        ranks = [x.round(9).rank() for x in (own.ref, own.small - own.ref - (clean.small - clean.ref).loc[own.index])]
        rho = None if len(own) < 6 or any(r.nunique() < 2 for r in ranks) else round(ranks[0].corr(ranks[1]), 6)
        want[cond] = (len(own), near, rho)
    assert {r.cond_id: (r.models, r.near_floor, None if r.rho is None else round(r.rho, 6)) for r in got.collect()} == want
    assert len(want) == 3 and any(rho is not None for _, _, rho in want.values())
