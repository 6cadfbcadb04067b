"""Units of work: which types to look for in which context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tables that a model gives (types by collection, endpoints) have a row a declared type or pair of types.


def units(contexts: DataFrame, types_by_collection: DataFrame, level: str) -> DataFrame:
    """(context, type) of every context whose collections the type is looked for in, each once."""
    wanted = types_by_collection.where(F.col("context_level") == level)
    return contexts.select("context_id", "collection_name").join(F.broadcast(wanted), "collection_name").select("context_id", "context_level", "entity_type_name").distinct()


def requests(units_: DataFrame) -> DataFrame:
    """One request a context, with all its types."""
    return units_.groupBy("context_level", "context_id").agg(F.sort_array(F.collect_set("entity_type_name")).alias("types"))


def rendered_types(units_: DataFrame, by: str, type_name: str) -> DataFrame:
    """The types that a request lists, by name."""
    return units_.groupBy(by).agg(F.array_sort(F.collect_set(type_name)).alias("types"))


def both_ways(endpoints: DataFrame) -> DataFrame:
    """Endpoints of symmetric types the other way round as well."""
    turned = endpoints.where("symmetric").select("relationship_type_name", F.col("target_type").alias("source_type"), F.col("source_type").alias("target_type"), F.col("target_level").alias("source_level"), F.col("source_level").alias("target_level"), "symmetric")
    return endpoints.unionByName(turned).distinct()


def _ends(endpoints: DataFrame) -> DataFrame:
    side = lambda s: endpoints.select("relationship_type_name", F.col(f"{s}_type").alias("entity_type_name"), F.col(f"{s}_level").alias("context_level"))
    return side("source").unionByName(side("target")).distinct()


def viable(types_here: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(chunk, relationship type) where some endpoint finds its source and its target type at their levels.

    types_here: chunk_id, context_level, entity_type_name; the types of a chunk's document are rows of the chunk, at level DOCUMENT. Only
    types that some endpoint names are shuffled, once, into the set of each chunk, which has an entry a declared end at most.
    """
    end = lambda s: F.struct(F.col(f"{s}_level").alias("context_level"), F.col(f"{s}_type").alias("entity_type_name"))
    at = ["context_level", "entity_type_name"]
    named = types_here.select("chunk_id", *at).join(F.broadcast(_ends(endpoints).select(*at).distinct()), at, "left_semi")
    sets = named.groupBy("chunk_id").agg(F.collect_set(F.struct(*at)).alias("types"))
    sources = sets.select("chunk_id", "types", F.explode("types").alias("source")).select("chunk_id", "types", "source.*")
    declared = endpoints.select("relationship_type_name", F.col("source_level").alias("context_level"), F.col("source_type").alias("entity_type_name"), end("target").alias("target"))
    return sources.join(F.broadcast(declared), at).where(F.array_contains("types", F.col("target"))).select("chunk_id", "relationship_type_name").distinct()


def candidates(entities_here: DataFrame, viable_: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Entities of a chunk that may be an end of one of its viable relationship types, at their level."""
    ends = _ends(endpoints)
    wanted = viable_.join(F.broadcast(ends), "relationship_type_name").select("chunk_id", "context_level", "entity_type_name").distinct()
    # most entities go before they are shuffled, as no endpoint names their type
    named = entities_here.join(F.broadcast(ends.select("context_level", "entity_type_name").distinct()), ["context_level", "entity_type_name"], "left_semi")
    return named.join(wanted, ["chunk_id", "context_level", "entity_type_name"], "left_semi")


def level_pairs(rules: DataFrame) -> DataFrame:
    """Each pair of source and target level of every rule, once a pair of types."""
    return rules.select("source_type", "target_type", F.explode("source_levels").alias("source_level"), "target_levels").select("source_type", "target_type", "source_level", F.explode("target_levels").alias("target_level")).distinct()


def added_conflicts(before: DataFrame, after: DataFrame, document: str) -> DataFrame:
    """Documents whose relationships were looked for already and that would gain a unit."""
    gather = lambda df, name: df.groupBy(document).agg(F.collect_set(F.struct("context_level", "entity_type_name")).alias(name))
    gained = F.array_except("new", "old")
    return gather(before, "old").join(gather(after, "new"), document).withColumn("n_gained", F.size(gained).cast("long")).where("n_gained > 0").select(document, "n_gained")
