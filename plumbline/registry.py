"""All queries by name, each with its DuckDB twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["operators.scalars", "operators.splits", "operators.metrics", "operators.resample", "operators.compare", "operators.alarm", "operators.latency", "operators.quantise", "operators.sketches", "operators.damage", "operators.quality", "operators.text_checks", "streaming.streams", "streaming.keyed", "sources.files", "plans.labels"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"plumbline.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"plumbline.{m}").ORACLE
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cmp_envelope"](spark, sf_dir)
