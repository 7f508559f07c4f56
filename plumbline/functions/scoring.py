"""Scalar functions over class scores: built-in array functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row (projections that are merged would repeat it for each class)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round12(x: Column) -> Column:
    """A share rounded to 12 digits, by whole multiples of 1e-12 as DuckDB does it (F.round goes through decimal text)."""
    return F.floor(x * 1e12 + 0.5) / F.lit(1e12)


def softmax(z: Column) -> Column:
    """Stable softmax in double precision, rounded to 12 digits so that ties are ties everywhere."""
    shares = lambda e: let(_total(e), lambda s: F.transform(e, lambda x: round12(x / s)))
    return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: F.exp(x - top)), shares))


def with_probabilities(scores: DataFrame, z: str = "z") -> DataFrame:
    return scores.withColumn("p", softmax(F.col(z)))


def first_best(z: Column) -> Column:
    """The class with the highest score; the lowest class wins ties."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("long")


def label_rank(z: Column, label: Column) -> Column:
    """The place of the label among the scores, from 1, in stable order."""
    own = F.element_at(z, label + 1)
    return 1 + F.size(F.filter(z, lambda x, i: (x > own) | ((x == own) & (i < label))))


def tied(z: Column) -> Column:
    """How many classes share the first place."""
    return F.size(F.filter(z, lambda x: x == F.array_max(z)))


def best_classes(z: Column, k: int = 5) -> Column:
    """The k best classes, best first."""
    pairs = F.array_sort(F.transform(z, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(F.slice(pairs, 1, k), lambda x: x["i"].cast("int"))


def nll(z: Column, label: Column, temperature: Column | float = 1.0) -> Column:
    """Log-sum-exp minus the true class's score, at a temperature."""
    t = F.lit(temperature) if isinstance(temperature, float) else temperature
    top = F.array_max(z)
    return F.log(_total(F.transform(z, lambda x: F.exp((x - top) / t)))) + (top - F.element_at(z, label + 1)) / t


def prediction_set(p: Column, q: Column) -> Column:
    """The classes with p >= 1 - q (this very expression: rewriting it can flip the boundary row)."""
    return F.filter(F.transform(p, lambda x, i: F.when(x >= 1 - q, i.cast("int"))), lambda x: x.isNotNull())


def interval_side(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, "above zero").when(hi < 0, "below zero").otherwise("includes zero")


def formatted(value: Column, kind: str) -> Column:
    """A value as it is printed: pct, pct0, pct1, points, size, ratio, mb or int."""
    patterns = {"pct": ("%.2f%%", 100.0), "pct0": ("%.0f%%", 100.0), "pct1": ("%.1f%%", 100.0), "points": ("%+.2f points", 100.0), "size": ("%.2f", 1.0), "ratio": ("%.2f×", 1.0), "mb": ("%.1f MB", 1e-6), "int": ("%.0f", 1.0)}
    pattern, scale = patterns[kind]
    return F.format_string(pattern, value * scale)
