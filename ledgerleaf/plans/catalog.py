"""Registry of queries by the operator's id, each with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    from ..operators import artifacts, blocks, chat, mart, notes, page_runs, pages, queue, records, reports, schemas, stages, stored, timeline, transitions  # noqa: F401
