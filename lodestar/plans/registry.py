"""Named queries: each takes (spark, sf_dir) and returns a DataFrame; some have an SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import settled

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the SQL that gives the same rows where SQL can."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")

        @wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(settled(spark), sf_dir)

        self.queries[name] = run
        if sql is not None:
            self.sql[name] = sql

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a function under its own name, or `name`."""

        def register(f: Query) -> Query:
            self.add(name or f.__name__, f, sql)
            return f

        return register
