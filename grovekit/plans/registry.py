"""Named queries of the engine, each with the SQL that an independent engine runs for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, fn: Query, sql: str | None = None) -> Query:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = fn
        if sql:
            self.sql[name] = sql
        return fn

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        return lambda fn: self.add(name, fn, sql)
