"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query function, with the SQL it is held against where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(columns: dict[str, int | None]) -> list[str]:
    """Select expressions: doubles rounded (and -0.0 made 0.0), others as they are."""
    return [k if d is None else f"round({k}, {d}) + 0e0 as {k}" for k, d in columns.items()]
