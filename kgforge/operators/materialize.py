"""Objects from an extractor's responses: decoded, typed, checked, identified, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgforge.functions import identity, keys, values
from kgforge.functions.documents import decode_response, items_of, unwrap_singleton
from kgforge.model.schema import DEFAULT_STRATEGY, EntityType, Field, Model, RelationshipType

from . import merge, relationships

SPARK_TYPE = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "string"}


def items(responses: DataFrame, key: str) -> DataFrame:
    """job_id, context_level, context_id, types, item and the object v of every item of the responses."""
    decoded = responses.withColumn("_v", decode_response(F.col("content")))
    return decoded.select("job_id", "context_level", "context_id", "types", F.posexplode(items_of(F.col("_v"), key)).alias("item", "v"))


def of_type(rows: DataFrame, marker: str) -> DataFrame:
    """Rows with type_name: the job's type of that name, else the one that differs in case only."""
    said = F.trim(F.try_variant_get("v", f"$.{marker}", "string"))
    same = F.filter("types", lambda t: F.lower(t) == F.lower(said))
    found = F.when(F.array_contains("types", said), said).otherwise(F.get(same, F.lit(0)))
    return rows.withColumn("type_name", found).where("type_name IS NOT NULL")


def field_value(f: Field, level: str) -> Column:
    """A field's value at a level: the constant of DEFAULT, nothing for SKIP, else what the item says if it is valid, or the default."""
    constant = F.lit(f.default.get(level)).cast(SPARK_TYPE[f.data_type])
    mode = f.mode(level)
    if mode == "SKIP":
        return F.lit(None).cast(SPARK_TYPE[f.data_type])
    if mode == "DEFAULT":
        return constant
    raw, options = unwrap_singleton(F.try_variant_get("v", f"$.{f.name}", "variant")).try_cast("string"), list(f.options) or None
    normal = lambda x: values.normalize_string(x, options) if f.data_type == "string" else values.NORMALIZERS[f.data_type](x)
    valid = lambda x: F.when(values.is_valid(x, f.data_type, options, f.regex.get(level), f.least.get(level), f.most.get(level)), x)
    # each step is worked out once, however often the next one needs it
    return F.coalesce(values.bound(values.bound(raw, normal), valid), constant)


def typed(rows: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """A column a field; rows that lack a required one are left out."""

    def value(f: Field) -> Column:
        if f.alike_at_all_levels():
            return field_value(f, "CHUNK")
        return F.when(F.col("context_level") == "DOCUMENT", field_value(f, "DOCUMENT")).otherwise(field_value(f, "CHUNK"))

    out = rows.withColumns({f"f_{f.name}": value(f) for f in fields})
    needed = [F.col(f"f_{f.name}").isNotNull() for f in fields if f.required]
    for ok in needed:
        out = out.where(ok)
    return out


def properties(fields: tuple[Field, ...]) -> Column:
    """The fields that aren't null, as text."""
    pairs = F.array(*[F.when(F.col(f"f_{f.name}").isNotNull(), F.struct(F.lit(f.name).alias("key"), F.col(f"f_{f.name}").cast("string").alias("value"))) for f in sorted(fields, key=lambda f: f.name)])
    return F.map_from_entries(F.array_compact(pairs))


ORDER = ["level_rank", "context_id", "item"]


def decoded(responses: DataFrame) -> DataFrame:
    """responses with whether their content could be read as JSON."""
    return responses.withColumn("decoded", F.coalesce(decode_response(F.col("content")).isNotNull(), F.lit(False)))


def typed_items(responses: DataFrame, key: str, marker: str, others: tuple[str, ...] = ()) -> DataFrame:
    """Every item of a known type, as JSON (item_json), with other markers that it has: what is decoded once for all types."""
    rows = of_type(items(responses, key), marker)
    return rows.select("job_id", "context_level", "context_id", "item", "type_name", F.to_json("v").alias("item_json"), *[F.try_variant_get("v", f"$.{m}", "string").alias(n) for n, m in others])


def entities_of(rows: DataFrame, types: list[EntityType]) -> DataFrame:
    """entity_id, entity_type_name, context and properties of every valid entity of typed_items(), in an order of its own."""
    out = None
    for t in types:
        own = typed(rows.where(F.col("type_name") == t.name).withColumn("v", F.parse_json("item_json")), t.fields)
        pk = keys.normalize_pk(F.col(f"f_{t.primary_key}").cast("string"))
        own = own.withColumn("entity_id", identity.entity_id(F.lit(t.name), pk)).where("entity_id IS NOT NULL")
        own = own.select("entity_id", F.col("type_name").alias("entity_type_name"), "job_id", "context_level", "context_id", "item", F.when(F.col("context_level") == "DOCUMENT", 0).otherwise(1).alias("level_rank"), properties(t.fields).alias("properties"))
        out = own if out is None else out.unionByName(own)
    return out


def entity_mentions(responses: DataFrame, types: list[EntityType]) -> DataFrame:
    return entities_of(typed_items(responses, "entities", "_entity_type"), types)


ENDS = (("source_ref", "_source_entity_id"), ("target_ref", "_target_entity_id"))


def relationship_items(responses: DataFrame) -> DataFrame:
    return typed_items(responses, "relationships", "_relationship_type", ENDS)


def relationships_of(rows: DataFrame, references: DataFrame, model: Model, endpoints: DataFrame) -> DataFrame:
    """relationship_id, type, ends, context and properties of every valid relationship of relationship_items(); references: what a job's temporary ids stand for."""
    declared = endpoints.select(F.col("relationship_type_name").alias("type_name"), "source_type", "target_type", "source_level", "target_level").distinct()
    # an entity that was found at both levels may do at either, but the item counts once
    said = relationships.resolved(rows.select("job_id", "item", "type_name", "source_ref", "target_ref"), references)
    ends = said.join(F.broadcast(declared), declared.columns, "left_semi").select("job_id", "item", "source_id", "target_id").distinct()  # a row a declared pair
    rows = rows.join(ends, ["job_id", "item"])
    out = None
    for r in model.active_relationships:
        own = rows.where(F.col("type_name") == r.name).withColumns({"allow_self": F.lit(r.allow_self), "v": F.parse_json("item_json")})
        own = typed(relationships.without_self(own), r.fields)
        pk = keys.normalize_pk(F.col(f"f_{r.primary_key}").cast("string")) if r.policy == "PRIMARY_KEY" else F.lit(None).cast("string")
        own = own.withColumns({"relationship_type_name": F.lit(r.name), "policy": F.lit(r.policy), "symmetric": F.lit(r.symmetric), "pk": pk, "occurrence": F.concat_ws("|", "context_level", "context_id", F.col("item").cast("string"))})
        own = relationships.identified(own.where(F.lit(r.policy != "PRIMARY_KEY") | F.col("pk").isNotNull()))
        own = own.select("relationship_id", "relationship_type_name", "source_id", "target_id", "job_id", "context_level", "context_id", "item", F.lit(1).alias("level_rank"), (properties(r.fields) if r.fields else F.create_map().cast("map<string,string>")).alias("properties"))
        out = own if out is None else out.unionByName(own)
    return out


def relationship_mentions(responses: DataFrame, references: DataFrame, model: Model, endpoints: DataFrame) -> DataFrame:
    return relationships_of(relationship_items(responses), references, model, endpoints)


def merged(mentions: DataFrame, types: list[EntityType] | list[RelationshipType], key: str, type_name: str, carried: tuple[str, ...] = (), stored: DataFrame | None = None) -> DataFrame:
    """One row an object: its properties merged by the fields' strategies, what is stored first, then in the order of level, context and item."""
    out = None
    for t in types:
        wide = lambda rows: rows.where(F.col(type_name) == t.name).select(key, *carried, "_after", *ORDER, "n_mentions", *[F.try_element_at("properties", F.lit(f.name)).cast(SPARK_TYPE[f.data_type]).alias(f"f_{f.name}") for f in t.fields])  # noqa: E731, B023
        own = wide(mentions.withColumns({"_after": F.lit(1), "n_mentions": F.lit(1).cast("long")}))
        if stored is not None:
            first = {c: F.lit(None).cast(mentions.schema[c].dataType) for c in ORDER}
            own = wide(stored.withColumns({"_after": F.lit(0), **first})).unionByName(own)
        one = own.groupBy(key, *carried).agg(F.sum("n_mentions").alias("n_mentions"), *[merge.merged(F.col(f"f_{f.name}"), F.struct("_after", *ORDER), f.data_type, f.strategy or t.strategy or DEFAULT_STRATEGY).alias(f"f_{f.name}") for f in t.fields])
        one = one.select(key, F.lit(t.name).alias(type_name), *carried, "n_mentions", (properties(t.fields) if t.fields else F.create_map().cast("map<string,string>")).alias("properties"))
        out = one if out is None else out.unionByName(one)
    return out


def provenance(mentions: DataFrame, key: str) -> DataFrame:
    return mentions.select("context_level", "context_id", key).distinct()
