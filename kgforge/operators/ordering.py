"""Orders, pages, samples, and what depends on neighbours in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next rows by keys beyond a cursor."""
    here = rows if after is None else rows.where(F.struct(*keys) > F.struct(*[F.lit(x).cast(rows.schema[k].dataType) for k, x in zip(keys, after, strict=True)]))
    return here.orderBy(*keys).limit(size)


def shuffled_key(seed: int, salt: str, value: Column) -> Column:
    """A pseudo-random order that is the same everywhere."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), value.cast("string")), 256)


def sample(rows: DataFrame, key: str, size: int, seed: int = 0, salt: str = "") -> DataFrame:
    return rows.withColumn("_order", shuffled_key(seed, salt, F.col(key))).orderBy("_order", key).limit(size).drop("_order")


def first_values(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """The first distinct values of each key, in the order they were first seen."""
    seen = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_first", value))
    return seen.withColumn("position", rank).where(F.col("position") <= most).drop("_first")


def smoothed(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential smoothing of a key's values in order; a key's values are few (snapshots of a run)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value].cast("double"))
    step = lambda a, x: F.when(a.isNull(), x).otherwise(alpha * x + (1 - alpha) * a)
    return rows.groupBy(key).agg(F.aggregate(ordered, F.lit(None).cast("double"), step).alias("smoothed"))


def rates(snapshots: DataFrame, key: str, time_s: str, done: str, *ties: str) -> DataFrame:
    """What was done a minute since the snapshot before; ties: what orders snapshots of one second."""
    w = Window.partitionBy(key).orderBy(time_s, *ties)
    per_minute = F.try_divide((F.col(done) - F.lag(done).over(w)) * 60.0, F.col(time_s) - F.lag(time_s).over(w))
    return snapshots.withColumn("per_minute", per_minute)


def top_by_ratio(rows: DataFrame, part: str, total: str, most: int) -> DataFrame:
    """The groups with the smallest share, larger ones first among equals."""
    name = [c for c in rows.columns if c not in (part, total)]
    return rows.withColumn("share", F.col(part) / F.col(total)).orderBy("share", F.desc(total), *name).limit(most)
