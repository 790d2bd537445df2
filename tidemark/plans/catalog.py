"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``check`` is standard SQL over the same tables with the same result."""

    def register(run: Query) -> Query:
        if key in QUERIES:
            raise KeyError(f"Query '{key}' is registered twice")
        QUERIES[key] = run
        if check is not None:
            CHECKS[key] = check
        return run

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from tidemark.plans import (  # noqa: F401
        documents,
        governance,
        metrics,
        profiles,
        registry,
        rules,
        sources,
        sql_surface,
        streams,
        trees,
    )
