"""The query catalogue: one entry per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries of one module with their plain-SQL statement of the same result."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(build: Query) -> Query:
            self.queries[name] = build
            if sql is not None:
                self.sql[name] = sql
            return build

        return register
