"""Queries by name, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import EVENTS_SQL, EVENTS_TEXT_SQL, FEATURES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_VIEWS = {"ev": EVENTS_SQL, "evt": EVENTS_TEXT_SQL, "ft": FEATURES_SQL}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` names the adapter views that its SQL reads."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = ("WITH RECURSIVE " + ",".join(_VIEWS[v] for v in views.split()) + "\n" if views else "") + sql.strip()
        return f

    return put
