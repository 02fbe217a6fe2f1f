"""Name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in CATALOGUE:
            raise ValueError(f"query {name!r} registered twice")
        CATALOGUE[name] = (fn, sql)
        return fn

    return register
