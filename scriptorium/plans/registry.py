"""All queries of the core library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin if SQL can express it."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def load_all() -> None:
    """Import the modules that register queries."""
    from scriptorium.plans import call_queries, chunk_queries, dedup_queries, document_queries, ingest_queries, map_queries, markdown_queries, state_queries, text_queries, time_queries  # noqa: F401
