"""The registry of named queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, directory) -> DataFrame under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def values(rows) -> str:
    """Rows as the body of a SQL VALUES list."""
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(text(x) for x in row) + ")" for row in rows)


def names(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)
