"""Queries over the supplied tables for the engine's operators, each with a DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def take(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return take


def everything() -> Catalog:
    from . import inputs, patterns, rules, tables, versions

    out = Catalog()
    for part in (patterns, tables, versions, rules, inputs):
        out.queries |= part.CATALOG.queries
        out.sql |= part.CATALOG.sql
    return out
