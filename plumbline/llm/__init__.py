"""Operators for large training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["bpe", "token_counts", "simhash", "mixing", "sharding", "licences", "media", "toxicity", "html_text", "neighbours", "line_dedup", "divergence", "collocations"]


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"plumbline.llm.{m}"), name)
    return out


def queries() -> dict[str, Callable]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
