"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name: (query, SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with the SQL that must give the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _load() -> dict:
    from lectern.plans import card_queries, document_queries, event_queries, library_queries, page_queries, rule_queries, stream_queries  # noqa: F401

    return QUERIES


def queries() -> dict[str, Callable]:
    return {name: q for name, (q, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql}
