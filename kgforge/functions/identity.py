"""Content-addressed identities, as lower-case hexadecimal of 16 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "v1"


def content_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def composed(*parts: Column | str) -> Column:
    """Hash of the parts behind the version, all joined by bars."""
    return content_hash(F.concat_ws("|", F.lit(VERSION), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def chunk_id(document_id: Column, index: Column) -> Column:
    """By document and position, so the text of a chunk plays no part."""
    return composed(document_id, index)


def entity_id(type_name: Column, normalized_pk: Column) -> Column:
    return F.when(normalized_pk.isNotNull(), composed(type_name, normalized_pk))


def instance_id(content_id: Column) -> Column:
    """A surrogate that stays the same from run to run."""
    return content_hash(F.concat(F.lit("inst|"), content_id))


def time_ordered_id(milliseconds: Column, seed: Column) -> Column:
    """A UUID of version 7: sorts by time, and the rest follows from the seed, so a repeated run gives the same."""
    t, h = F.lpad(F.lower(F.hex(milliseconds.cast("bigint"))), 12, "0"), F.sha2(seed, 256)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(t, 1, 8), F.substring(t, 9, 4), F.concat(F.lit("7"), F.substring(h, 1, 3)), F.concat(variant, F.substring(h, 5, 3)), F.substring(h, 8, 12))


def ends(source: Column, target: Column, symmetric: Column) -> Column:
    plain = F.concat_ws("|", source, target)
    return F.when(symmetric, F.concat_ws("|", F.lit("SYMMETRIC"), F.least(source, target), F.greatest(source, target))).otherwise(plain)


def oriented(source: Column, target: Column, symmetric: Column) -> tuple[Column, Column]:
    """Of a symmetric relationship the smaller end comes first."""
    return F.when(symmetric, F.least(source, target)).otherwise(source), F.when(symmetric, F.greatest(source, target)).otherwise(target)


def relationship_id(type_name: Column, policy: Column, source: Column, target: Column, symmetric: Column, pk: Column, occurrence: Column) -> Column:
    """By policy: PRIMARY_KEY takes the ends and the key, ENDPOINTS the ends, NONE the occurrence (never merged)."""
    both = ends(source, target, symmetric)
    return (
        F.when(policy == "PRIMARY_KEY", composed(type_name, F.lit("PRIMARY_KEY"), both, pk))
        .when(policy == "ENDPOINTS", composed(type_name, F.lit("ENDPOINTS"), both))
        .when(policy == "NONE", content_hash(F.concat_ws("|", F.lit("none"), type_name, occurrence.cast("string"))))
    )
