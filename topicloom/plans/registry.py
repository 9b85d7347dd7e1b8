"""Registry of the named queries shipped with the engine.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` over the driver
tables, optionally paired with an oracle SQL string that restates it for
DuckDB. Queries without an oracle are checked by row count and by the
invariants in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
