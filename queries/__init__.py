"""The query catalogue: every operator as a Spark query, most with an equivalent SQL text."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

MODULES = ["scan", "landed", "rows", "joins", "aggregates", "windows", "segments", "scalars", "domain", "labels", "models", "refresh"]


def load() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"queries.{module}")
    return QUERIES, SQL
