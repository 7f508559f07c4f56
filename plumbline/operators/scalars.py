"""Per-item columns over class scores (no shuffle in any of them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.fixtures import duck, scores
from plumbline.functions import scoring as S
from plumbline.operators.outcomes import CELL, clean_thresholds, outcomes, with_sets

KEY = [*CELL, "item"]


def fn_softmax(df: DataFrame) -> DataFrame:
    return S.with_probabilities(df).select(*KEY, F.array_max("p").alias("p_max"), F.element_at("p", F.col("label") + 1).alias("p_true"))


def fn_confidence_correct(df: DataFrame) -> DataFrame:
    return outcomes(df).select(*KEY, "confidence", "pred", "correct")


def fn_topk_correct(df: DataFrame, k: int = 5) -> DataFrame:
    return df.select(*KEY, (S.label_rank(F.col("z"), F.col("label")) <= k).cast("int").alias("in_top"))


def fn_top5_list(df: DataFrame) -> DataFrame:
    return df.select(*KEY, F.array_join(S.best_classes(F.col("z"), 5).cast("array<string>"), ",").alias("top5"))


def fn_tied(df: DataFrame) -> DataFrame:
    z = F.col("z")
    return df.select(*KEY, (S.tied(z) > 1).alias("is_tied"), (F.element_at(z, F.col("label") + 1) == F.array_max(z)).alias("label_tied_best"))


def fn_temperature(df: DataFrame, t: float = 1.7) -> DataFrame:
    """Confidence after scaling, and whether the top answer is unchanged."""
    scaled = df.withColumns({"before": S.first_best(F.col("z")), "z": F.transform("z", lambda x: x / t)})
    return outcomes(scaled).select(*KEY, "confidence", (F.col("before") == F.col("pred")).alias("same_answer"))


def fn_nll(df: DataFrame, t: float = 1.0) -> DataFrame:
    return df.select(*KEY, F.round(S.nll(F.col("z"), F.col("label"), t), 9).alias("nll"))


def fn_nonconformity(df: DataFrame) -> DataFrame:
    return S.with_probabilities(df).select(*KEY, F.round(1 - F.element_at("p", F.col("label") + 1), 12).alias("nonconformity"))


def fn_prediction_set(df: DataFrame) -> DataFrame:
    scored = outcomes(df)
    return with_sets(scored.filter("split <> 'conformal_calibration'"), clean_thresholds(scored), ["model", "build"]).select(*KEY, "size", "covered")


def fn_mean_over_variants(df: DataFrame) -> DataFrame:
    """Each item's mean over the damaged conditions, per build."""
    return outcomes(df.filter("cond_id <> 'clean'")).groupBy("model", "build", "item").agg(F.round(F.avg("correct"), 9).alias("mean_correct"), F.round(F.avg(F.round("confidence", 6)), 12).alias("mean_confidence"))


def fn_format(df: DataFrame) -> DataFrame:
    top = outcomes(df).groupBy(*CELL).agg(F.sum("correct").cast("long").alias("hits"), F.count("*").alias("n"))
    share = F.col("hits") / F.col("n")
    return top.select(*CELL, S.formatted(share, "pct").alias("pct"), S.formatted(share, "pct1").alias("pct1"), S.formatted(share - 0.5, "points").alias("points"), S.formatted(F.col("hits").cast("double"), "int").alias("whole"))


_K = "model, build, cond_id, item"
_RUN = {
    "fn_softmax": (fn_softmax, f"select {_K}, list_max(p) p_max, p[label + 1] p_true from probs", ["probs"]),
    "fn_confidence_correct": (fn_confidence_correct, f"select {_K}, confidence, pred, correct from outcomes", ["outcomes"]),
    "fn_topk_correct": (fn_topk_correct, f"select {_K}, case when 1 + len(list_filter(z, lambda x, i: x > z[label + 1] or (x = z[label + 1] and i - 1 < label))) <= 5 then 1 else 0 end in_top from scores", ["scores"]),
    "fn_top5_list": (fn_top5_list, f"select {_K}, array_to_string(list_transform(list_sort(list_transform(z, lambda x, i: {{'s': -x, 'i': i - 1}}))[1:5], lambda x: x.i), ',') top5 from scores", ["scores"]),
    "fn_tied": (fn_tied, f"select {_K}, len(list_filter(z, lambda x: x = list_max(z))) > 1 is_tied, z[label + 1] = list_max(z) label_tied_best from scores", ["scores"]),
    "fn_temperature": (fn_temperature, f"select {_K}, list_max(list_transform(e, lambda v: round(v / list_sum(e), 12))) confidence, list_position(z, list_max(z)) = list_position(zt, list_max(zt)) same_answer from (select *, list_transform(zt, lambda v: exp(v - list_max(zt))) e from (select *, list_transform(z, lambda v: v / 1.7::double) zt from scores))", ["scores"]),
    "fn_nll": (fn_nll, f"select {_K}, round(ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) + list_max(z) - z[label + 1], 9) nll from scores", ["scores"]),
    "fn_nonconformity": (fn_nonconformity, f"select {_K}, round(1 - p[label + 1], 12) nonconformity from probs", ["probs"]),
    "fn_prediction_set": (fn_prediction_set, f"select {_K}, size, covered from sets", ["sets"]),
    "fn_mean_over_variants": (fn_mean_over_variants, "select model, build, item, round(avg(correct), 9) mean_correct, round(avg(round(confidence, 6)), 12) mean_confidence from outcomes where cond_id <> 'clean' group by all", ["outcomes"]),
    "fn_format": (fn_format, "select model, build, cond_id, printf('%.2f%%', 100.0::double * h / n) pct, printf('%.1f%%', 100.0::double * h / n) pct1, printf('%+.2f points', 100.0::double * (h / n - 0.5::double)) points, printf('%.0f', h) whole from (select model, build, cond_id, sum(correct) h, count(*)::double n from outcomes group by all)", ["outcomes"]),
}
QUERIES = {n: (lambda f: lambda spark, sf: f(scores(spark, sf)))(f) for n, (f, _, _) in _RUN.items()}
ORACLE = {n: duck(sql, *ctes) for n, (_, sql, ctes) in _RUN.items()}
