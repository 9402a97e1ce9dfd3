"""Registry of queries ``key -> fn(spark, sf_dir) -> DataFrame`` and oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("customer", "owner", "similarity", "rankers", "forecast", "evaluation", "profiling", "io", "notebook")


def query(key: str, sql: str | None = None):
    """Register ``fn`` under ``key``; ``sql`` is its DuckDB oracle (None = rows-only check)."""

    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"tidewater.plans.{m}")
