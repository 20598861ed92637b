"""The queries of the core, each with its SQL where SQL can state it.

A module of plans registers its queries with @query(sql); the SQL is what DuckDB must return for the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ("record_queries", "audit_queries", "encode_queries", "metric_queries", "grid_queries", "corpus_queries")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")
