"""Named queries with, where SQL can express them, their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.plans.oracle import with_parts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(
    name: str, sql: str | None = None, extra: dict[str, str] | None = None
) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may mention the parts of ``plans.oracle`` and ``extra`` ones."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = with_parts(sql, extra)
        return function

    return register


def load_all() -> None:
    from vitrine.plans import (  # noqa: F401
        catalog,
        entities,
        feeds,
        monitor,
        owners,
        refresh,
        report,
        streams,
        text,
        traffic,
    )
