"""Queries on the smaller operators: projections, predicates, grouped views, set operations, batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgforge.functions import text
from kgforge.operators import documents as docs
from kgforge.operators import lifecycle, materialize, planning, provenance
from kgforge.sources.tables import by_type
from kgforge.workflow import remote

from .knowledge import ID, LINES, content, endpoints, part_links, stored
from .registry import Tables, query


@query("p01_type_projection", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#25')")
def p01(t: Tables) -> DataFrame:
    return by_type(t.part, "p_brand", ["Brand#11", "Brand#25"]).select("p_partkey")


@query("p05_type_names", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_type IN ('view', 'click') THEN event_type END AS type_name FROM events WHERE event_id % 4 <> 3 AND event_type IN ('view', 'click')")
def p05(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.col("event_type")).when(k == 1, F.concat(F.lit(" "), F.upper("event_type"))).when(k == 2, F.concat(F.initcap("event_type"), F.lit(" ")))
    rows = t.events.select("event_id", F.array(F.lit("view"), F.lit("click")).alias("types"), F.parse_json(F.to_json(F.struct(said.alias("_entity_type")))).alias("v"))
    return materialize.of_type(rows, "_entity_type").select("event_id", "type_name")


@query("p11_oriented_endpoints", "SELECT * FROM (VALUES ('Supplies', 'Brand#11', 'BUILDING', 'CHUNK', 'DOCUMENT'), ('Supplies', 'Brand#12', 'MACHINERY', 'CHUNK', 'DOCUMENT'), ('Pairs', 'Brand#13', 'Brand#21', 'CHUNK', 'CHUNK'), ('Pairs', 'Brand#21', 'Brand#13', 'CHUNK', 'CHUNK')) v(relationship_type_name, source_type, target_type, source_level, target_level)")
def p11(t: Tables) -> DataFrame:
    return endpoints(t).drop("symmetric")


@query("p14_open_batches", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND (user_id IS NULL OR value > 20)")
def p14(t: Tables) -> DataFrame:
    batches = t.events.select("event_id", F.when(F.col("event_type") == "view", "SUBMITTED").when(F.col("event_type") == "click", "IN_PROGRESS").otherwise("COMPLETED").alias("batch_status"), F.when(F.col("user_id").isNotNull(), F.when(F.col("value") > 20, "CHUNK").otherwise("DOCUMENT")).alias("context_level"))
    return lifecycle.open_batches(batches, "CHUNK").select("event_id")


@query("j03_chunks_of_documents", f"WITH {LINES} SELECT f.doc_id, c.chunk_index, length(c.content) AS n_chars FROM c JOIN (SELECT {ID} AS content_id, min(doc_id) AS doc_id FROM documents GROUP BY 1) f USING (content_id)")
def j03(t: Tables) -> DataFrame:
    return docs.line_chunks(stored(t)).join(stored(t).select("content_id", "doc_id"), "content_id").select("doc_id", "chunk_index", F.length("content").cast("bigint").alias("n_chars"))


@query("j06_relationships_by_chunk", "SELECT l_orderkey AS chunk, string_agg(DISTINCT l_suppkey || '>' || l_partkey, ';' ORDER BY l_suppkey || '>' || l_partkey) AS relationships FROM lineitem GROUP BY 1")
def j06(t: Tables) -> DataFrame:
    links = t.lineitem.withColumnRenamed("l_orderkey", "chunk")
    return provenance.relationships_by_context(links, "chunk", "l_suppkey", "l_partkey").withColumn("relationships", text.joined(F.col("relationships")))


@query("j11_existing_rows", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def j11(t: Tables) -> DataFrame:
    return docs.existing(t.part, t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey", "p_brand")


@query("j13_batches_with_jobs", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j13(t: Tables) -> DataFrame:
    return lifecycle.with_jobs(t.customer, t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("j16_entities_of_contexts", "SELECT DISTINCT l_orderkey AS chunk, l_partkey AS entity_id, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def j16(t: Tables) -> DataFrame:
    of = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk"))
    return provenance.objects_of_contexts(part_links(t), of, t.part.select(F.col("p_partkey").alias("entity_id"), "p_brand"), "chunk", "entity_id").select("chunk", "entity_id", "p_brand")


@query("a12_collections_of_documents", f"SELECT {ID} AS content_id, string_agg(DISTINCT source, ';' ORDER BY source) AS collections FROM documents GROUP BY 1")
def a12(t: Tables) -> DataFrame:
    return docs.collections_of(docs.memberships(content(t), "source")).withColumn("collections", text.joined(F.col("collections")))


@query("w02_neighbouring_chunks", f"WITH {LINES} SELECT content_id, chunk_index, coalesce(length(lag(content) OVER (PARTITION BY content_id ORDER BY chunk_index)), 0) AS before FROM c")
def w02(t: Tables) -> DataFrame:
    rows = docs.with_neighbour(docs.line_chunks(stored(t)), F.length("content"), "before")
    return rows.select("content_id", "chunk_index", F.coalesce("before", F.lit(0)).cast("bigint").alias("before"))


@query("o05_rendered_types", "SELECT string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS types, p_type FROM part GROUP BY p_type")
def o05(t: Tables) -> DataFrame:
    return planning.rendered_types(t.part, "p_type", "p_brand").withColumn("types", text.joined(F.col("types")))


@query("u07_set_difference", "SELECT o_custkey AS id, count(DISTINCT o_orderpriority) FILTER (WHERE (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')) AS n_new FROM orders GROUP BY 1")
def u07(t: Tables) -> DataFrame:
    before = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(docs.gained(before, F.col("o_orderpriority")).alias("n_new"))


@query("u08_union_of_levels", "SELECT 'DOCUMENT' AS context_level, o_custkey AS context_id, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'CHUNK', l_orderkey, count(*) FROM lineitem GROUP BY 2")
def u08(t: Tables) -> DataFrame:
    return provenance.union_of_levels({"DOCUMENT": t.orders.select(F.col("o_custkey").alias("context_id")), "CHUNK": t.lineitem.select(F.col("l_orderkey").alias("context_id"))})


@query("u10_distinct_in_order", "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def u10(t: Tables) -> DataFrame:
    return docs.first_per_key(t.events.select("event_type", F.col("event_id").alias("first_seen")), ["event_type"], F.col("first_seen"))


@query("f22_code_fences", "SELECT event_id, props AS body FROM events")
def f22(t: Tables) -> DataFrame:
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```\n"))).otherwise(F.col("props"))
    return t.events.select("event_id", text.strip_code_fence(fenced).alias("body"))


@query("f24_day_zero", "SELECT event_id, CASE event_id % 2 WHEN 0 THEN '01 May ' || (1900 + user_id) ELSE '10 May ' || (1900 + user_id) END AS day FROM events")
def f24(t: Tables) -> DataFrame:
    raw = F.concat(F.when(F.col("event_id") % 2 == 0, "00").otherwise("10"), F.lit(" May "), (1900 + F.col("user_id")).cast("string"))
    return t.events.select("event_id", text.without_day_zero(raw).alias("day"))


@query("f26_json_pairs", "SELECT p_partkey, unnest(['a', 'b']) AS k, unnest([p_brand, p_type]) AS v FROM part")
def f26(t: Tables) -> DataFrame:
    said = F.to_json(F.array(F.array(F.lit("a"), "p_brand"), F.array(F.lit("b"), "p_type")))
    pairs = t.part.select("p_partkey", F.explode(F.from_json(said, "array<array<string>>")).alias("x"))
    return pairs.select("p_partkey", F.get("x", F.lit(0)).alias("k"), F.get("x", F.lit(1)).alias("v"))


@query("f27_reference_mapping", "SELECT l_orderkey AS job_id, '{' || string_agg('\"E' || l_linenumber || '\":{\"id\":' || k || ',\"type\":\"Part\"}', ',' ORDER BY 'E' || l_linenumber) || '}' AS mapping FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k FROM lineitem GROUP BY ALL) GROUP BY 1")
def f27(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    entry = F.struct(F.concat(F.lit("E"), F.col("l_linenumber").cast("string")).alias("key"), F.struct(F.col("k").alias("id"), F.lit("Part").alias("type")).alias("value"))
    return rows.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("mapping"))


@query("f36_batch_results", """
SELECT CAST(event_id AS VARCHAR) AS job_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'transient' WHEN 2 THEN 'config' WHEN 3 THEN 'response' WHEN 4 THEN 'truncated' ELSE 'internal' END AS error_class,
 CASE event_id % 6 WHEN 0 THEN event_type END AS content, CASE WHEN event_id % 6 IN (0, 3, 4) THEN user_id END AS input_tokens FROM events""")
def f36(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    usage = F.struct(F.col("user_id").cast("string").alias("input"))
    body = F.when(k.isin(0, 3, 4), F.struct(F.when(k != 3, F.col("event_type")).alias("content"), (k == 4).alias("truncated"), usage.alias("usage")))
    status = F.when(k == 1, 429).when(k == 2, 404).when(k != 5, 200)
    lines = t.events.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("job_id"), status.alias("status"), body.alias("body"))).alias("value"))
    return remote.responses_of_lines(lines).select("job_id", "error_class", "content", "input_tokens")


@query("f37_whole_input", "SELECT event_id, user_id + CAST(floor(value) AS BIGINT) + event_id % 5 AS input_tokens FROM events")
def f37(t: Tables) -> DataFrame:
    return t.events.select("event_id", remote.whole_input(F.col("user_id"), F.floor("value").cast("bigint"), F.col("event_id") % 5).alias("input_tokens"))


@query("x11_status_report", "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS n_documents, count(*) AS n_chunks, (SELECT count(*) FROM lineitem JOIN orders b ON b.o_orderkey = l_orderkey WHERE b.o_orderstatus = a.o_orderstatus) AS n_units FROM orders a GROUP BY 1")
def x11(t: Tables) -> DataFrame:
    units = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return lifecycle.status_report(t.orders.withColumnRenamed("o_orderstatus", "status"), units, "status", "o_custkey", "o_orderkey")


@query("x01_viable_requests", """
WITH u AS (SELECT DISTINCT l_orderkey AS context_id, 'CHUNK' AS context_level, p_brand AS ty FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT context_level, context_id, string_agg(ty, ';' ORDER BY ty) AS types FROM u GROUP BY ALL""")
def x01b(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("context_id"), F.lit("CHUNK").alias("context_level"), F.col("p_brand").alias("entity_type_name"))
    return planning.requests(rows).withColumn("types", text.joined(F.col("types")))
