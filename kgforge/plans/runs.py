"""Queries on what a run does: ingestion, chunks, units of work, materialised objects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgforge.functions import identity
from kgforge.model.loader import model_of
from kgforge.operators import chunking, lifecycle, materialize, planning
from kgforge.operators import documents as docs
from kgforge.sources import files

from .knowledge import ID, LINES, content, stored
from .operations import STATUS_SQL, millis, units
from .registry import Tables, query


def scratch(t: Tables, tag: str) -> str:
    """A new folder that driver and executors share: below the one that the session names, or of this machine where nothing else runs."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kgforge-")
    return f"{base.rstrip('/')}/kgforge-{tag}-{uuid.uuid4().hex}"


# Sources: a folder of text files, one an item of the benchmark and a blank one, in folders of their own.
@query("s03_recursive_scan", "SELECT substr(sha256(text || chr(10)), 1, 32) AS content_id, CAST(length(text) + 1 AS BIGINT) AS n_chars FROM benchmark GROUP BY ALL")
def s03(t: Tables) -> DataFrame:
    root = scratch(t, "texts")
    blank = t.spark.createDataFrame([(-1, "  \t ")], "item_id long, text string")
    t.benchmark.select("item_id", "text").unionByName(blank).repartition("item_id").write.partitionBy("item_id").text(root)
    found = files.scan(t.spark, root, {"root": ".", "mode": "recursive"})
    return found.select("content_id", F.length("text").cast("bigint").alias("n_chars")).distinct()


@query("s02_directory_scan", "SELECT CAST(0 AS BIGINT) AS n_files")
def s02(t: Tables) -> DataFrame:
    """Files of subfolders are none of the folder's."""
    root = scratch(t, "texts")
    t.benchmark.select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(root)
    return files.scan(t.spark, root, {"root": ".", "mode": "directory"}).agg(F.count("*").alias("n_files"))


# Chunks: their own form has no SQL, but what holds for any of them has.
PLAN = chunking.Plan(target=120)
WORDS = r"string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"
TEXTS = f"d AS (SELECT {ID} AS content_id, any_value(text) AS text FROM documents GROUP BY 1)"


@query("c02_chunk_tokens", f"WITH {TEXTS} SELECT content_id, CAST(len({WORDS}) AS BIGINT) AS n_tokens FROM d WHERE regexp_matches(text, '\\S')")
def c02(t: Tables) -> DataFrame:
    """Without overlaps every word is in one chunk."""
    chunks = chunking.chunks(stored(t), chunking.Plan(target=120, overlap=0))
    return chunks.groupBy("content_id").agg(F.sum(F.size(F.regexp_extract_all("content", F.lit(r"(\S+)"), F.lit(1)))).alias("n_tokens"))


@query("c03_chunk_limits", f"WITH {TEXTS} SELECT content_id, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_gaps FROM d WHERE regexp_matches(text, '\\S')")
def c03(t: Tables) -> DataFrame:
    """No chunk is over the limit and its overlap, and indices have no gaps."""
    most = chunking.default_limit(PLAN.target) + chunking.default_overlap(PLAN.target)
    over = F.size(F.regexp_extract_all("content", F.lit(r"(\S+)"), F.lit(1))) > most
    return chunking.chunks(stored(t), PLAN).groupBy("content_id").agg(F.count_if(over).alias("n_over"), (F.max("chunk_index") + 1 - F.count("*")).cast("bigint").alias("n_gaps"))


@query("c04_chunk_cover", f"WITH {TEXTS} SELECT content_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS n_covered, TRUE AS in_place FROM d WHERE regexp_matches(text, '\\S')")
def c04(t: Tables) -> DataFrame:
    """Overlapping chunks cover all that isn't blank, and stand where their offsets say."""
    chunks = chunking.chunks(stored(t), PLAN)
    before = F.coalesce(F.max("end_offset").over(Window.partitionBy("content_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.substr("content", F.greatest(before - F.col("start_offset"), F.lit(0)) + 1)
    own = chunks.withColumn("n", F.length(F.regexp_replace(new, r"\s", ""))).join(stored(t).select("content_id", F.col("text").alias("whole")), "content_id")
    placed = F.substr("whole", F.col("start_offset") + 1, F.length("content")) == F.col("content")
    return own.groupBy("content_id").agg(F.sum("n").cast("bigint").alias("n_covered"), F.bool_and(placed).alias("in_place"))


# Runs: documents in English were there, all of them are scanned again.
@query("t01_incremental_ingestion", f"""
WITH {LINES}, s AS (SELECT DISTINCT {ID} AS content_id FROM documents WHERE lang = 'en')
SELECT content_id, count(*) AS n_chunks FROM c WHERE content_id NOT IN (SELECT content_id FROM s) GROUP BY 1""")
def t01(t: Tables) -> DataFrame:
    there = content(t).where("lang = 'en'").select("content_id").distinct()
    return docs.line_chunks(docs.unseen(stored(t), there)).groupBy("content_id").agg(F.count("*").alias("n_chunks"))


@query("f07_time_ordered_ids", """
WITH x AS (SELECT event_id, printf('%012x', epoch_us(ts) // 1000) AS t, sha256(CAST(event_id AS VARCHAR)) AS h FROM events)
SELECT event_id, concat_ws('-', substr(t, 1, 8), substr(t, 9, 4), '7' || substr(h, 1, 3), substr('89ab', CAST(('0x' || substr(h, 4, 1))::INT % 4 + 1 AS BIGINT), 1) || substr(h, 5, 3), substr(h, 8, 12)) AS id FROM x""")
def f07(t: Tables) -> DataFrame:
    return t.events.select("event_id", identity.time_ordered_id(millis("ts"), F.col("event_id").cast("string")).alias("id"))


#: Units that are stored: events but purchases; all events are planned again.
STATE = f"u AS (SELECT user_id, event_id, {STATUS_SQL} AS status, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)"


def planned_again(t: Tables) -> DataFrame:
    there = units(t).where("status <> 'COMPLETED'").select(F.lit("CHUNK").alias("context_level"), "context_id", F.col("event_id").alias("entity_type_name"), "status", F.lit(1).alias("attempts"), F.lit(0).alias("failed"), F.lit(None).cast("string").alias("last_error"))
    new = units(t).select(F.lit("CHUNK").alias("context_level"), "context_id", F.col("event_id").alias("entity_type_name"))
    return lifecycle.planned(new, there, ["context_level", "context_id", "entity_type_name"])


@query("t02_units_of_a_run", f"""
WITH {STATE}, c AS (SELECT event_id, k, CASE WHEN status IN ('PENDING', 'COMPLETED') THEN 'IN_PROGRESS' ELSE status END AS status, CASE status WHEN 'PENDING' THEN 2 ELSE 1 END AS attempts, status IN ('PENDING', 'COMPLETED', 'IN_PROGRESS') AS run FROM u),
o AS (SELECT *, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'transient' WHEN k % 4 = 2 THEN 'response' ELSE 'config' END AS error FROM c)
SELECT event_id, CASE WHEN NOT run THEN status WHEN error IS NULL THEN 'COMPLETED' WHEN error = 'transient' THEN 'RETRY' WHEN error = 'response' THEN 'PENDING' ELSE 'FAILED' END AS status,
  attempts - CASE WHEN run AND error = 'transient' THEN 1 ELSE 0 END AS attempts, CASE WHEN run AND error = 'response' THEN 1 ELSE 0 END AS failed FROM o""")
def t02(t: Tables) -> DataFrame:
    """Planned, claimed, answered, resolved by the answers' errors."""
    keys = ["context_level", "context_id", "entity_type_name"]
    known = planned_again(t)
    taken = lifecycle.claim(known, None)
    now = known.join(taken.select(*keys), keys, "left_anti").unionByName(taken)
    kind = F.when(F.col("k") % 4 == 1, "transient").when(F.col("k") % 4 == 3, "config")
    jobs = units(t).select("event_id", F.col("event_id").cast("string").alias("job_id"), F.when(kind.isNull(), F.when(F.col("k") % 4 == 0, "[]").otherwise("no JSON")).alias("content"), kind.alias("error_class"))
    told = lifecycle.outcomes(materialize.decoded(jobs)).withColumn("entity_type_name", F.col("job_id").cast("bigint"))
    return lifecycle.resolve(now, told, ["entity_type_name"]).select(F.col("entity_type_name").alias("event_id"), "status", "attempts", "failed")


@query("t04_claim_all", f"WITH {STATE} SELECT event_id, CAST(CASE status WHEN 'PENDING' THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM u WHERE status IN ('PENDING', 'COMPLETED')")
def t04(t: Tables) -> DataFrame:
    return lifecycle.claim(planned_again(t), None).select(F.col("entity_type_name").alias("event_id"), "attempts")


@query("x11_progress", f"WITH {STATE} SELECT status, count(*) AS n_units FROM u GROUP BY 1")
def x11(t: Tables) -> DataFrame:
    return lifecycle.progress(units(t).withColumn("attempts", F.lit(0))).select("status", "n_units")


# Objects: parts are what responses tell of, each by its brand's response, which names all parts of the brand and what is no part.
MODEL = {
    "entity_types": {
        "Part": {"primary_key": "name", "document_collections": {"chunk": "all"}, "fields": {
            "name": {"data_type": "string", "required": True}, "size": {"data_type": "int", "min": 5, "merge_strategy": "max"}, "kind": {"data_type": "string", "options": ["PROMO", "STANDARD"], "default_value": "STANDARD"}, "price": {"data_type": "float", "merge_strategy": "min"}}},
        "Brand": {"primary_key": "name", "document_collections": {"chunk": "all"}, "fields": {"name": {"data_type": "string", "required": True}}},
    },
    "relationship_types": {"MadeBy": {"endpoints": {"Part": {"Brand": {"source_context_levels": "chunk", "target_context_levels": "chunk"}}}, "deduplication": "endpoints"}},
}
NAMED = "n AS (SELECT p_name, p_brand, CASE WHEN p_size >= 5 THEN p_size END AS size, round(p_retailprice, 2) AS price, p_partkey FROM part)"


def part_responses(t: Tables) -> DataFrame:
    item = F.struct(F.lit(" part").alias("_entity_type"), F.array("p_name").alias("name"), F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("size"), F.lit("promo ").alias("kind"), F.round("p_retailprice", 2).alias("price"))
    listed = F.collect_list(F.to_json(item))
    said = F.concat(F.lit('Here: {"entities": ['), F.array_join(listed, ","), F.lit(', {"_entity_type": "Brand", "name": "'), F.col("p_brand"), F.lit('"}, {"_entity_type": "Ship", "name": "x"}, 7, {"_entity_type": "Part"}]}'))
    return t.part.groupBy("p_brand").agg(said.alias("content")).select(F.col("p_brand").alias("job_id"), F.lit("CHUNK").alias("context_level"), F.col("p_brand").alias("context_id"), F.array(F.lit("Part"), F.lit("Brand")).alias("types"), "content")


@query("x04_entities", f"""
WITH {NAMED}
SELECT substr(sha256('v1|Part|' || p_name), 1, 32) AS entity_id, count(*) AS n_mentions, p_name AS name, CAST(max(size) AS VARCHAR) AS size, 'PROMO' AS kind, min(price) AS price FROM n GROUP BY p_name""")
def x04(t: Tables) -> DataFrame:
    types = [x for x in model_of(MODEL).active_entities if x.name == "Part"]
    out = materialize.merged(materialize.entity_mentions(part_responses(t), types), types, "entity_id", "entity_type_name")
    value = lambda f: F.try_element_at("properties", F.lit(f))
    return out.select("entity_id", "n_mentions", value("name").alias("name"), value("size").alias("size"), value("kind").alias("kind"), value("price").cast("double").alias("price"))


@query("x05_relationships", f"""
WITH {NAMED}, e AS (SELECT DISTINCT substr(sha256('v1|Part|' || p_name), 1, 32) AS source_id, substr(sha256('v1|Brand|' || lower(p_brand)), 1, 32) AS target_id FROM n)
SELECT substr(sha256('v1|MadeBy|ENDPOINTS|' || source_id || '|' || target_id), 1, 32) AS relationship_id, source_id, target_id FROM e""")
def x05(t: Tables) -> DataFrame:
    model = model_of(MODEL)
    mentions = materialize.entity_mentions(part_responses(t), model.active_entities)
    here = mentions.select("job_id", "context_level", "entity_id", "entity_type_name").distinct()
    from kgforge.operators import relationships

    references = here.join(relationships.temporary_ids(here), ["job_id", "entity_id"])
    brand = references.where("entity_type_name = 'Brand'").select("job_id", F.col("temp_id").alias("b"))
    item = F.to_json(F.struct(F.lit("madeby").alias("_relationship_type"), F.concat(F.lit(" "), F.lower("temp_id")).alias("_source_entity_id"), F.col("b").alias("_target_entity_id")))
    wrong = '{"_relationship_type": "MadeBy", "_source_entity_id": "E0", "_target_entity_id": "E1"}'
    said = references.where("entity_type_name = 'Part'").join(brand, "job_id").groupBy("job_id").agg(F.concat(F.lit('{"relationships": ['), F.array_join(F.collect_list(item), ","), F.lit(f", {wrong}]}}")).alias("content"))
    responses = said.select("job_id", F.lit("CHUNK").alias("context_level"), F.col("job_id").alias("context_id"), F.array(F.lit("MadeBy")).alias("types"), "content")
    endpoints = planning.both_ways(t.spark.createDataFrame(model.endpoint_rows(), "relationship_type_name string, source_type string, target_type string, source_level string, target_level string, symmetric boolean"))
    return materialize.relationship_mentions(responses, references, model, endpoints).select("relationship_id", "source_id", "target_id").distinct()
