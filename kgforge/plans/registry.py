"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgforge.sources.tables import table


class Tables:
    """The tables of a directory, as attributes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name, with SQL for the same result if there is any."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, root: f(Tables(spark, root))
        if sql:
            SQL[name] = sql
        return f

    return add
