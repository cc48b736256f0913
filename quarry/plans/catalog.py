"""Registered queries: each is ``fn(spark, sf_dir) -> DataFrame`` over the
given tables (whole tables, no subsets), optionally paired with an
equivalent DuckDB SQL string over the same tables (the correctness oracle).
Column names agree between the two.
"""

from __future__ import annotations

from collections.abc import Callable

import functools

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ship_package

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)  # Python workers (mapInPandas etc.) import quarry
            return fn(spark, sf_dir)

        REGISTRY[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


_MODULES = (
    "q_retrieval",
    "q_fulltext",
    "q_safety",
    "q_evaluation",
    "q_inference",
    "q_mlpipe",
    "q_extraction",
    "q_pages",
    "q_search",
    "q_models",
    "q_streaming",
)


def _load() -> None:
    import importlib
    for m in _MODULES:
        importlib.import_module(f"quarry.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
