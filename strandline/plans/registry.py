"""Queries and their SQL by name."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            assert name not in self.queries, name

            @functools.wraps(query)
            def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return query(spark, sf_dir)

            self.queries[name] = shipped
            if sql:
                self.sql[name] = sql
            return query

        return keep
