"""Text files below a root, as documents."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from kgforge.functions.identity import content_hash
from kgforge.functions.text import decode_utf8, is_blank

MODES = ("file", "directory", "recursive")


class SourceError(ValueError):
    """All that is wrong with the sources, at once."""


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file://")


def check_sources(sources: list[dict], root: str) -> None:
    """Local sources are inside the root, there, of their kind, and texts."""
    wrong = []
    if not is_local(root):
        return
    base = Path(root.removeprefix("file://")).resolve()
    for s in sources:
        path = (base / s["root"]).resolve()
        if s["mode"] not in MODES:
            wrong.append(f"{s['root']}: no mode {s['mode']}")
        elif not path.is_relative_to(base):
            wrong.append(f"{s['root']}: outside of the root")
        elif not path.exists():
            wrong.append(f"{s['root']}: not found")
        elif (s["mode"] == "file") != path.is_file():
            wrong.append(f"{s['root']}: not a {'file' if s['mode'] == 'file' else 'directory'}")
        elif s["mode"] == "file" and path.suffix != ".txt":
            wrong.append(f"{s['root']}: not a .txt file")
    if wrong:
        raise SourceError("; ".join(wrong))


def without_redundant(sources: list[dict]) -> list[dict]:
    """Without sources that another one covers."""
    def covers(a: dict, b: dict) -> bool:
        x, y = Path(a["root"]), Path(b["root"])
        if a["mode"] == "recursive":
            return y.is_relative_to(x) and not (x == y and b["mode"] == "recursive")
        return a["mode"] == "directory" and b["mode"] == "file" and y.parent == x

    unique = [s for k, s in enumerate(sources) if s not in sources[:k]]
    return [s for s in unique if not any(covers(o, s) for o in unique if o is not s)]


def scan(spark: SparkSession, root: str, source: dict) -> DataFrame:
    """source_uri, content_id and text of a source's .txt files; hidden and temporary ones, and those outside the root, are skipped."""
    reader = spark.read.format("binaryFile")
    path = f"{root.rstrip('/')}/{source['root']}".rstrip("/.") if source["root"] not in ("", ".") else root
    if source["mode"] != "file":
        reader = reader.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(source["mode"] == "recursive").lower())
    files = reader.load(path)
    below = F.substr("path", F.length(F.regexp_extract("path", "^(.*?)" + "\\Q" + path.removeprefix("file://").rstrip("/") + "\\E", 0)) + 1)
    files = files.where(~F.concat(F.lit("/"), F.ltrim(below, F.lit("/"))).rlike(r"/[.~]"))
    if source["mode"] == "directory":  # folders named like partitions are listed with their files
        files = files.where(~F.contains(F.ltrim(below, F.lit("/")), F.lit("/")))
    if is_local(root):
        base = str(Path(root.removeprefix("file://")).resolve())
        real = _real_path(F.col("path"))
        files = files.where(F.startswith(real, F.lit(base + "/")))
    out = files.select(F.col("path").alias("source_uri"), content_hash(F.col("content")).alias("content_id"), decode_utf8(F.col("content")).alias("text"))
    return out.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


@pandas_udf(StringType())
def _real_path(path: pd.Series) -> pd.Series:
    """Local paths with their links followed."""
    return path.map(lambda x: os.path.realpath(x.removeprefix("file:")))


def scan_registry(spark: SparkSession, root: str, registry: dict[str, list[dict]]) -> DataFrame:
    """collection_name, source_uri, content_id and text of all collections."""
    parts = [scan(spark, root, s).withColumn("collection_name", F.lit(name)) for name, sources in registry.items() for s in without_redundant(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("collection_name", "source_uri", "content_id", "text").distinct()


def reload_checked(spark: SparkSession, documents: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored documents' texts, and those whose file has changed or gone."""
    now = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(root)
    found = now.select(F.col("path").alias("source_uri"), content_hash(F.col("content")).alias("found_id"), decode_utf8(F.col("content")).alias("text"))
    both = documents.join(found, "source_uri", "left")
    same = F.col("content_id").eqNullSafe(F.col("found_id"))
    return both.where(same).drop("found_id"), both.where(~same).drop("text")
