"""Parquet tables by name, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def by_type(rows: DataFrame, column: str, types: list[str]) -> DataFrame:
    """The rows of some types only; the filter reaches the scan."""
    return rows.where(rows[column].isin(types))


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record a non-blank line, read by the given schema, not by a guess; broken lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
