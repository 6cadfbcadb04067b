"""Counts, durations, tokens and cost of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = ("input", "cached", "cache_write", "output", "reasoning")


def enumeration(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def sources_by_status(units: DataFrame, statuses: DataFrame, source: str = "context_id") -> DataFrame:
    """Distinct sources by status of their units, zero included; one of mixed statuses counts under each."""
    counted = units.groupBy("status").agg(F.count_distinct(source).alias("n"))
    return statuses.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n_sources"))


def by_status(rows: DataFrame, statuses: DataFrame, status: str = "status") -> DataFrame:
    return statuses.join(rows.groupBy(status).agg(F.count("*").alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n_rows"))


def durations(jobs: DataFrame, *by: str) -> DataFrame:
    """Average, least and most milliseconds of finished jobs, whole, 0 where there are none."""
    took = F.when(F.col("finished_at").isNotNull(), F.col("finished_at") - F.col("created_at"))
    whole = lambda f: F.coalesce(f(took).cast("bigint"), F.lit(0).cast("bigint"))
    return jobs.groupBy(*by).agg(whole(F.avg).alias("avg_ms"), whole(F.min).alias("min_ms"), whole(F.max).alias("max_ms"))


def weighted_average(parts: DataFrame) -> DataFrame:
    """Of averages and their counts."""
    return parts.agg(F.coalesce(F.try_divide(F.sum(F.col("avg_ms") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("avg_ms"))


def tokens(jobs: DataFrame, *by) -> DataFrame:
    return jobs.groupBy(*by).agg(*[F.coalesce(F.sum(f"{t}_tokens"), F.lit(0)).alias(f"{t}_tokens") for t in TOKENS])


def tokens_by_mode(jobs: DataFrame) -> DataFrame:
    return tokens(jobs, F.when(F.col("batch_id").isNotNull(), "batch").otherwise("realtime").alias("mode"))


def cost(by_mode: DataFrame, rates: DataFrame) -> DataFrame:
    """By mode: millionths of rates for each kind of token, reasoning as output, batches at a discount. rates has one row."""
    each = F.col("input_tokens") * F.col("input_rate") + F.col("cached_tokens") * F.col("cached_rate") + F.col("cache_write_tokens") * F.col("cache_write_rate") + (F.col("output_tokens") + F.col("reasoning_tokens")) * F.col("output_rate")
    factor = F.when(F.col("mode") == "batch", 1 - F.col("batch_discount")).otherwise(1.0)
    return by_mode.crossJoin(F.broadcast(rates.limit(1))).select("mode", (each / 1_000_000 * factor).alias("cost"))


def ratio(a, b):
    """Zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def wall_clock(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.min("created_at").alias("first_ms"), F.max("finished_at").alias("last_ms"), F.count_if(F.col("job_status") != "COMPLETED").alias("not_completed"), F.count("*").alias("n_jobs"))


def step_seconds(runs: DataFrame) -> DataFrame:
    return runs.groupBy("step_name").agg((F.sum("duration_ms") / 1000).alias("seconds"))


def rollup_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by all the columns, by ever fewer of them, and in all; a total's columns are null."""
    return rows.rollup(*by).agg(F.count("*").alias("n_rows"))
