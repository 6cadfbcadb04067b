"""How extracted triples, values or labels compare with what was expected."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prf(tp, fp, fn) -> list:
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1")]


def micro(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 over sums of tp, fp and fn; null where there is nothing to divide by."""
    return rows.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Means over the keys of expected; a key with nothing right or nothing found counts 0."""
    sets = lambda df, name: df.groupBy(key).agg(F.collect_set(F.trim(value)).alias(name))
    both = sets(expected, "gold").join(sets(found, "own"), key, "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    right = F.size(F.array_intersect("gold", "own"))
    p, r = F.coalesce(F.try_divide(right, F.size("own")), F.lit(0.0)), F.coalesce(F.try_divide(right, F.size("gold")), F.lit(0.0))
    each = both.select(p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))
    return each.agg(F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg("f").alias("macro_f1"))


def rates_of(rows: DataFrame, **conditions) -> DataFrame:
    """The share of rows for which each condition holds."""
    return rows.agg(*[F.avg(c.cast("int")).alias(name) for name, c in conditions.items()])


def causes(rows: DataFrame, ordered: dict, otherwise: str) -> DataFrame:
    """Rows by the first of the causes that applies."""
    cause = None
    for name, condition in ordered.items():
        cause = F.when(condition, name) if cause is None else cause.when(condition, name)
    return rows.withColumn("cause", cause.otherwise(otherwise))


def f1_ceiling(rows: DataFrame, key: str, reachable: str) -> DataFrame:
    """The mean of the best F1 that each key's reachable part allows."""
    each = rows.groupBy(key).agg(F.count_if(reachable).alias("ok"), F.count("*").alias("gold"))
    return each.agg(F.sum("ok").alias("reachable"), F.sum("gold").alias("gold"), F.avg(2 * F.col("ok") / (F.col("gold") + F.col("ok"))).alias("f1_ceiling"))


def overlap(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    """Distinct trimmed texts of test that train has as well."""
    own = lambda df: df.select(F.trim(text).alias("t")).distinct()
    return own(test).join(own(train), "t", "left_semi").agg(F.count("*").alias("n_shared"))


#: Replicates whose draws of a row come from one hash, 16 bits each.
DRAWS = 8


def poisson_steps(most: int = 8) -> list[float]:
    """The chances that a Poisson number of mean one is at most 0, 1, ... (most - 1)."""
    out, term = [], math.exp(-1)
    for k in range(most):
        out.append(term + (out[-1] if out else 0.0))
        term /= k + 1
    return out


def bootstrap(rows: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """95 % interval of micro F1 over resampled rows; rows that are equal are drawn alike, so they need a column that tells them apart.

    The number of times that a row is drawn is Poisson of mean one, by hash of row and replicate, so no replicate needs its rows in one
    place: sums by replicate are combined before the shuffle.
    """
    row = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in rows.columns])
    blocks = rows.withColumn("_key", row).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS) - 1))))
    hashed = blocks.withColumn("_h", F.md5(F.concat("_key", F.lit("|"), F.col("_block").cast("string")))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    numbered = hashed.withColumn("_rep", F.col("_block") * DRAWS + F.col("_k")).where(F.col("_rep") < replicates)
    u = (F.conv(F.substr("_h", F.col("_k") * 4 + 1, F.lit(4)), 16, 10).cast("int") + 0.5) / 65536
    times = sum(((u > step).cast("int") for step in poisson_steps()), F.lit(0))
    sums = numbered.withColumn("_n", times).groupBy("_rep").agg(*[F.sum(F.col(c) * F.col("_n")).alias(c) for c in ("tp", "fp", "fn")])
    f1 = sums.select(*prf(F.col("tp"), F.col("fp"), F.col("fn"))).where("f1 IS NOT NULL")
    return f1.agg(F.percentile("f1", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*[F.round(F.get("q", F.lit(k)), 9).alias(name) for k, name in enumerate(("f1_low", "f1_high"))])


def first_verdicts(verdicts: DataFrame, n_items: str = "n_items") -> DataFrame:
    """The first verdict of each item; those for items that there are not don't count."""
    valid = verdicts.where((F.col("item") >= 0) & (F.col("item") < F.col(n_items)))
    return valid.groupBy("context_id", "item").agg(F.min_by("verdict", "position").alias("verdict"))


def filters_in_turn(rows: DataFrame, ordered: dict) -> DataFrame:
    """How many rows are left after each of the corrections, which add up."""
    kept, out = F.lit(True), []
    for name, condition in ordered.items():
        kept = kept & condition
        out.append(F.count_if(kept).alias(name))
    return rows.agg(F.count("*").alias("all_rows"), *out)
