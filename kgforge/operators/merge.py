"""Merging observations of one object, field by field, in one aggregation.

Nulls never win. Of dates one that refines another wins over any strategy. Order matters to keep and replace only, and to dates; it is
given by the caller, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = {
    "string": ("keep", "replace", "longest", "shortest"), "integer": ("keep", "replace", "largest", "smallest"), "float": ("keep", "replace", "largest", "smallest"),
    "boolean": ("keep", "replace", "largest", "smallest"), "date": ("keep", "replace", "largest", "smallest"),
}
# Other names that models use for the strategies.
ALIASES = {
    "existing": "keep", "preserve": "keep", "retain": "keep", "first": "keep", "incoming": "replace", "overwrite": "replace", "update": "replace", "last": "replace",
    "verbose": "longest", "complete": "longest", "concise": "shortest", "minimal": "shortest", "max": "largest", "maximum": "largest", "min": "smallest", "minimum": "smallest",
    "latest": "largest", "any": "largest", "or": "largest", "earliest": "smallest", "all": "smallest", "and": "smallest",
}


def strategy_name(name: str) -> str:
    """The strategy that a model means, in any case and with blanks around it."""
    name = name.strip().lower()
    return ALIASES.get(name, name)


def _date_fold(value: Column, order: Column, strategy: str) -> Column:
    """A left fold: what refines the date so far replaces it, what it refines is left out, else the strategy decides."""
    pick = {"keep": lambda a, v: a, "replace": lambda a, v: v, "largest": F.greatest, "smallest": F.least}[strategy]
    seen = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    step = lambda a, x: (
        F.when(a.isNull(), x["v"])
        .when(F.startswith(x["v"], a) & (F.length(x["v"]) > F.length(a)), x["v"])
        .when(F.startswith(a, x["v"]), a)
        .otherwise(pick(a, x["v"]))
    )
    return F.aggregate(seen, F.lit(None).cast("string"), step)


def merged(value: Column, order: Column, data_type: str, strategy: str) -> Column:
    strategy = strategy_name(strategy)
    if strategy not in STRATEGIES[data_type]:
        raise ValueError(f"{strategy} is no strategy for {data_type}")
    if data_type == "date":
        return _date_fold(value, order, strategy)
    given = F.when(value.isNotNull(), order)
    return {
        "keep": lambda: F.min_by(value, given),
        "replace": lambda: F.max_by(value, given),
        "longest": lambda: F.min_by(value, F.when(value.isNotNull(), F.struct(-F.length(value), value))) if data_type == "string" else None,
        "shortest": lambda: F.min_by(value, F.when(value.isNotNull(), F.struct(F.length(value), value))) if data_type == "string" else None,
        "largest": lambda: F.max(value),
        "smallest": lambda: F.min(value),
    }[strategy]()


def merge(rows: DataFrame, keys: list[str], order: Column, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a key; fields: data type and strategy of each."""
    return rows.groupBy(*keys).agg(*[merged(F.col(f), order, *spec).alias(f) for f, spec in fields.items()])


def merge_into(stored: DataFrame, new: DataFrame, keys: list[str], order: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """New observations merged into what is stored, which comes before them all."""
    before = stored.select(*keys, *fields, F.lit(0).alias("_after"), F.lit(None).cast(new.schema[order].dataType).alias(order))
    both = before.unionByName(new.select(*keys, *fields, F.lit(1).alias("_after"), order))
    return merge(both, keys, F.struct("_after", order), fields)


def altered(stored: DataFrame, result: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The merged rows that are new or differ from what is stored, so that nothing else is written again."""
    old = stored.select(*keys, F.struct(*fields).alias("_old"))
    return result.join(old, keys, "left").where(F.col("_old").isNull() | ~F.col("_old").eqNullSafe(F.struct(*fields))).drop("_old")
