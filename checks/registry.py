"""Queries with their SQL counterparts, collected by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmlens.session import ship, tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same question for DuckDB over the same tables."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            return query(ship(tune(spark)), sf.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return query

    return register
