"""Named queries over the driver tables, each with its DuckDB oracle SQL.

``REGISTRY[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is the SQL
twin (absent for learners whose result no SQL can state: rows-only check).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordtally.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every query module (each registers on import)."""
    from wordtally.plans import q_dictionary, q_evaluate, q_html, q_learn, q_merged, q_predict, q_registry, q_text, q_vectorize  # noqa: F401
