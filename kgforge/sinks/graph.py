"""A property graph as text lines or as typed CSV, and what was written."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgforge.functions.text import escape, float_text

from . import storage

#: Header suffix of each data type.
HEADER = {"string": "string", "integer": "long", "float": "double", "boolean": "boolean", "date": "date", "strings": "string[]"}


def property_text(value: Column, data_type: str) -> Column:
    """A value as exports write it: dates as their first day, floats at their shortest."""
    if data_type == "boolean":
        return F.when(value, "true").when(~value, "false")
    if data_type == "float":
        return float_text(value)
    if data_type == "date":
        return F.concat(value, F.when(F.length(value) == 4, "-01-01").when(F.length(value) == 7, "-01").otherwise(""))
    return value.cast("string")


def graph_lines(rows: DataFrame, label: str, key: str, fields: dict[str, str]) -> DataFrame:
    """A line a node: id, label, and its fields that aren't null, sorted by name."""
    parts = []
    for f in sorted(fields):
        text = property_text(F.col(f), fields[f])
        quoted = F.concat(F.lit('"'), F.replace(escape(text), F.lit('"'), F.lit('\\"')), F.lit('"')) if fields[f] in ("string", "date") else text
        parts.append(F.when(text.isNotNull(), F.concat(F.lit(f"{f}:"), quoted)))
    return rows.select(F.concat_ws(" ", F.concat(F.lit("N_"), F.col(key)), F.lit(f":{label}"), *parts).alias("value"))


def edge_lines(rows: DataFrame, type_name: str, source: str, target: str) -> DataFrame:
    return rows.select(F.concat(F.lit("N_"), F.col(source), F.lit("->N_"), F.col(target), F.lit(f" :{type_name}")).alias("value"))


def csv_rows(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """The columns of a node file, with the types in their names."""
    values = [property_text(F.col(f), t).alias(f"{f}:{HEADER[t]}") for f, t in sorted(fields.items())]
    return rows.select(F.col(key).alias("id:ID"), *values)


def csv_edges(rows: DataFrame, source: str, target: str, fields: dict[str, str]) -> DataFrame:
    values = [property_text(F.col(f), t).alias(f"{f}:{HEADER[t]}") for f, t in sorted(fields.items())]
    return rows.select(F.col(source).alias("source:START_ID"), F.col(target).alias("target:END_ID"), *values)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)


def import_script(nodes: dict[str, str], relationships: dict[str, str]) -> str:
    """A POSIX shell script that hands the files to a bulk importer named by its first argument."""
    lines = ["#!/bin/sh", "set -eu", 'exec "$@" \\']
    args = [f"  --nodes={label}={path}" for label, path in sorted(nodes.items())] + [f"  --relationships={name}={path}" for name, path in sorted(relationships.items())]
    return "\n".join([*lines, *(a + (" \\" if k + 1 < len(args) else "") for k, a in enumerate(args))]) + "\n"


def tally(rows: DataFrame, types: DataFrame, type_name: str) -> DataFrame:
    """Objects by type, those without any included."""
    return types.join(rows.groupBy(type_name).agg(F.count("*").alias("n")), type_name, "left").select(type_name, F.coalesce("n", F.lit(0)).alias("n_objects"))


def replace_directory(new: str, target: str) -> None:
    """Puts a finished directory in the place of another; at any time one of both is there."""
    old = f"{target}.old-{uuid.uuid4().hex}"
    had = storage.exists(target)
    if had:
        storage.rename(target, old)
    try:
        storage.rename(new, target)
    except OSError:
        if had:
            storage.rename(old, target)
        raise
    if had:
        storage.delete(old)


def write_stats(stats: dict, path: str) -> None:
    """Nested statistics as JSON, written whole or not at all."""
    storage.write_text(path, json.dumps(stats, indent=2, sort_keys=True) + "\n")


def triples_by_id(ids: DataFrame, triples: DataFrame, key: str = "id") -> DataFrame:
    """A JSON line an id with its distinct triples as first seen, an empty list if it has none."""
    seen = triples.groupBy(key, "sub", "rel", "obj").agg(F.min("position").alias("p"))
    lists = seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", F.array("sub", "rel", "obj").alias("t")))).alias("s"))
    joined = ids.select(key).join(lists, key, "left")
    found = F.coalesce(F.transform("s", lambda x: x["t"]), F.array().cast("array<array<string>>"))
    return joined.select(F.to_json(F.struct(F.col(key), found.alias("triples"))).alias("value"))


class Versions:
    """A dataset of parts with a list of those that count: a write or an appended part is seen whole or not at all."""

    #: Parts that are put together into one.
    MOST_PARTS = 32

    def __init__(self, root: str) -> None:
        self.root = str(root).rstrip("/")

    def parts(self) -> list[str]:
        names = storage.read_text(f"{self.root}/CURRENT")
        return [f"{self.root}/{n}" for n in names.split()] if names else []

    def current(self) -> str | None:
        """The newest part."""
        return next(reversed(self.parts()), None)

    def read(self, spark: SparkSession) -> DataFrame | None:
        paths = self.parts()
        return spark.read.parquet(*map(storage.uri, paths)) if paths else None

    def _add(self, rows: DataFrame, before: list[str]) -> None:
        name = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(storage.uri(f"{self.root}/{name}"))
        storage.write_text(f"{self.root}/CURRENT", "\n".join([*(p.rpartition("/")[2] for p in before), name]))

    def write(self, rows: DataFrame) -> None:
        """In place of all parts; those before stay until the next write, as rows may read them."""
        before = self.parts()
        self._add(rows, [])
        for path in storage.children(self.root):
            name = path.rpartition("/")[2]
            if name.startswith("v-") and name not in {p.rpartition("/")[2] for p in (*before, *self.parts())}:
                storage.delete(path)

    def append(self, rows: DataFrame) -> None:
        self._add(rows, self.parts())
        if len(self.parts()) > self.MOST_PARTS:
            self.write(self.read(rows.sparkSession))

    def clear(self) -> None:
        storage.delete(self.root)
