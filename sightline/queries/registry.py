"""Named queries, each with the SQL that must give the same rows, where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name. sql: the same in ANSI SQL over the tables' names."""

        def put(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"two queries are named {key}")

            @functools.wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(spark, sf_dir)

            self.queries[key] = run
            if sql:
                self.sql[key] = sql
            return run

        return put
