"""The queries of the engine and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import coverage_queries, learning_queries, record_queries, table_queries, works_queries

_PARTS = (works_queries, table_queries, record_queries, learning_queries, coverage_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.ORACLE_SQL.items()}
