"""Relationships: ends, identity, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgforge.functions.identity import oriented, relationship_id


def with_end_types(relationships: DataFrame, entities: DataFrame, key: str = "entity_id", type_name: str = "entity_type_name") -> DataFrame:
    of = lambda side: entities.select(F.col(key).alias(f"{side}_id"), F.col(type_name).alias(f"{side}_type"))
    return relationships.join(of("source"), "source_id").join(of("target"), "target_id")


def with_active_ends(relationships: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Those whose pair of types is active; the pairs come from the model, so they are few."""
    return relationships.join(F.broadcast(endpoints.select("source_type", "target_type").distinct()), ["source_type", "target_type"], "left_semi")


def without_self(relationships: DataFrame) -> DataFrame:
    """Without those from an object to itself, unless their type allows it."""
    return relationships.where("allow_self OR source_id <> target_id")


def identified(relationships: DataFrame) -> DataFrame:
    """With relationship_id by type, policy, symmetry, key and occurrence, and the ends of symmetric ones in order."""
    a, b = F.col("source_id"), F.col("target_id")
    key = relationship_id(F.col("relationship_type_name"), F.col("policy"), a, b, F.col("symmetric"), F.col("pk"), F.col("occurrence"))
    source, target = oriented(a, b, F.col("symmetric"))
    return relationships.withColumns({"relationship_id": key, "source_id": source, "target_id": target})


def resolved(items: DataFrame, references: DataFrame) -> DataFrame:
    """Items whose temporary ends (trimmed, in capitals) the job's references know, with what they stand for."""
    of = lambda side: references.select("job_id", F.col("temp_id").alias(f"{side}_ref"), F.col("entity_id").alias(f"{side}_id"), F.col("entity_type_name").alias(f"{side}_type"), F.col("context_level").alias(f"{side}_level"))
    clean = items.withColumns({f"{s}_ref": F.upper(F.trim(f"{s}_ref")) for s in ("source", "target")})
    return clean.join(of("source"), ["job_id", "source_ref"]).join(of("target"), ["job_id", "target_ref"])


def temporary_ids(entities: DataFrame) -> DataFrame:
    """E1, E2 … of a job's entities, each at its first context: those of the document before those of the chunk."""
    first = entities.groupBy("job_id", "entity_id").agg(F.min(F.when(F.col("context_level") == "DOCUMENT", 0).otherwise(1)).alias("level_rank"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("level_rank", "entity_id"))
    return first.withColumn("temp_id", F.concat(F.lit("E"), rank.cast("string"))).drop("level_rank")
