"""Per-item outcomes: probabilities, best class, confidence, correctness, prediction sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scoring as S
from plumbline.operators.ordered import running
from plumbline.shared import written

BUILD = ["model", "build"]
CELL = ["model", "build", "cond_id"]


def outcomes(scores: DataFrame, classes: int | None = None) -> DataFrame:
    """scores with p, confidence, pred and correct (1.0 or 0.0). Where the number of classes is given, exponentials are plain
    expressions, which stay in generated code, and p is formed only where it is asked for."""
    if classes is None:
        own = S.with_probabilities(scores).withColumn("confidence", F.array_max("p"))
    else:
        own = scores.withColumn("_top", F.array_max("z"))
        own = own.withColumn("_e", F.array(*[F.exp(F.col("z")[i] - F.col("_top")) for i in range(classes)]))
        own = own.withColumn("_s", sum((F.col("_e")[i] for i in range(classes)), F.lit(0.0)))
        # a method of generated code with all of them outgrows the compiler's limit; without let, each would add up the sum anew
        p = S.let(F.col("_s"), lambda s: F.transform("_e", lambda x: S.round12(x / s)))
        own = own.withColumns({"p": p, "confidence": S.round12(F.array_max("_e") / F.col("_s"))}).drop("_top", "_e", "_s")
    return own.withColumn("pred", S.first_best(F.col("z"))).withColumn("correct", (F.col("pred") == F.col("label")).cast("double"))


def conformal_threshold(calibration: DataFrame, keys: list[str], coverage: float = 0.9) -> DataFrame:
    """keys and q: the ceil((n + 1) * coverage)-th smallest 1 - p(true class), 1.0 if there is none.

    Scores are counted by value, and the counts summed up in blocks of the order: no task sorts a whole group.
    """
    counted = calibration.select(*keys, (1 - F.element_at("p", F.col("label") + 1)).alias("_s")).groupBy(*keys, "_s").agg(F.count("*").alias("_m"))
    ranked = running(counted, keys, "_s", {"_m": "_before"})
    wanted = ranked.groupBy(*keys).agg(F.ceil((F.sum("_m") + 1) * F.lit(float(coverage))).alias("_k"))
    reached = F.when(F.col("_before") + F.col("_m") >= F.col("_k"), F.col("_s"))
    return ranked.join(wanted, keys).groupBy(*keys).agg(F.coalesce(F.min(reached), F.lit(1.0)).alias("q"))


def clean_thresholds(scored: DataFrame, coverage: float = 0.9) -> DataFrame:
    """The threshold of each build from its clean calibration items."""
    return conformal_threshold(scored.filter("cond_id = 'clean' and split = 'conformal_calibration'"), BUILD, coverage)


def with_sets(scored: DataFrame, thresholds: DataFrame, on: list[str], classes: int | None = None) -> DataFrame:
    """scored with the prediction sets' size and whether they hold the label; thresholds are a row a build. Where the number
    of classes is given, the size is a plain expression, which stays in generated code."""
    own = scored.join(written(thresholds.sparkSession, thresholds, "thresholds"), on)
    if classes is None:
        size = F.size(F.filter("p", lambda x: x >= 1 - F.col("q")))
    else:
        size = sum(((F.col("p")[i] >= 1 - F.col("q")).cast("int") for i in range(classes)), F.lit(0))
    return own.withColumns({"size": size.cast("double"), "covered": (F.element_at("p", F.col("label") + 1) >= 1 - F.col("q")).cast("double")})
