"""Where objects were found: links of contexts to objects, grouped in the ways that planning and export ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_context(links: DataFrame, objects: DataFrame, context: list[str], key: str, type_name: str) -> DataFrame:
    """The objects of each context with their types, in the order of their keys."""
    joined = links.select(*context, key).distinct().join(objects.select(key, type_name), key)
    return joined.groupBy(*context).agg(F.sort_array(F.collect_list(F.struct(key, type_name))).alias("objects"))


def relationships_by_context(links: DataFrame, context: str, source: str, target: str) -> DataFrame:
    """The different pairs of ends of each context, as source>target in order."""
    return links.groupBy(context).agg(F.sort_array(F.collect_set(F.concat_ws(">", source, target))).alias("relationships"))


def objects_of_contexts(links: DataFrame, contexts: DataFrame, objects: DataFrame, context: str, key: str) -> DataFrame:
    """The objects of some contexts, each once a context."""
    return links.join(contexts.select(context), context, "left_semi").join(objects, key)


def union_of_levels(levels: dict[str, DataFrame], context: str = "context_id") -> DataFrame:
    """Links of all levels, by context: how many objects were found in each."""
    out = None
    for level, links in levels.items():
        own = links.groupBy(context).agg(F.count("*").alias("n")).select(F.lit(level).alias("context_level"), context, "n")
        out = own if out is None else out.unionByName(own)
    return out


def contexts_of(links: DataFrame, key: str, document: str, index: str) -> DataFrame:
    """The chunks of each object in the order of document and index."""
    ordered = F.array_sort(F.collect_set(F.struct(document, index)))
    return links.groupBy(key).agg(ordered.alias("contexts"))


def with_document_types(chunk_types: DataFrame, document_types: DataFrame, document: str) -> DataFrame:
    """Every chunk's types beside those of its document, none of which may be there."""
    return chunk_types.join(document_types, document, "left").withColumn("document_types", F.coalesce("document_types", F.array().cast("array<string>")))


def out_of_step(objects: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Objects without provenance and provenance without an object; both should be empty."""
    a = objects.select(key).join(links.select(key), key, "left_anti").select(key, F.lit("no provenance").alias("problem"))
    return a.unionByName(links.select(key).distinct().join(objects.select(key), key, "left_anti").select(key, F.lit("no object").alias("problem")))


def of_types(links: DataFrame, objects: DataFrame, types: DataFrame, key: str, type_name: str) -> DataFrame:
    """Links of objects whose type is active."""
    active = objects.join(F.broadcast(types), type_name, "left_semi")  # types come from the model, not from data
    return links.join(active.select(key), key, "left_semi")
