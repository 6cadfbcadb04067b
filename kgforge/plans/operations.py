"""Queries on units of work, jobs, metrics and orders.

Events are units and jobs: the kind of event is the status, a user is a source of work, value and props.k are counts; orders are jobs
whose creation is the order's date and whose end is the last shipment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgforge.operators import lifecycle, metrics, ordering, planning

from .registry import Tables, query

STATUSES = ["PENDING", "IN_PROGRESS", "RETRY", "COMPLETED", "FAILED", "UNUSED"]
STATUS_OF = {"view": "PENDING", "click": "IN_PROGRESS", "signup": "RETRY", "purchase": "COMPLETED", "error": "FAILED"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items()) + " END"
STATUS_ROWS = ", ".join(f"('{s}')" for s in STATUSES)
EPOCH = "timestamp_ntz'1970-01-01'"


def millis(column: str):
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, cast({column} AS timestamp_ntz))")


def units(t: Tables) -> DataFrame:
    return t.events.selectExpr("event_id", "user_id AS context_id", f"{STATUS_SQL} AS status", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "value", "ts")


def statuses(t: Tables) -> DataFrame:
    return metrics.enumeration(t.spark, "status", STATUSES)


@query("a01_counts", "SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM lineitem) AS n_mentions, (SELECT count(*) FROM orders) AS n_chunks")
def a01(t: Tables) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(t.documents, "n_documents").crossJoin(n(t.lineitem, "n_mentions")).crossJoin(n(t.orders, "n_chunks"))  # a row each


@query("a02_distinct_vs_mentions", "SELECT l_linestatus AS context_level, count(*) AS n_mentions, count(DISTINCT l_partkey) AS n_entities FROM lineitem GROUP BY 1")
def a02(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_linestatus").alias("context_level")).agg(F.count("*").alias("n_mentions"), F.count_distinct("l_partkey").alias("n_entities"))


@query("a03_sources_by_status", f"""
WITH u AS (SELECT {STATUS_SQL} AS status, user_id FROM events), s(status) AS (VALUES {STATUS_ROWS})
SELECT status, count(DISTINCT user_id) AS n_sources FROM s LEFT JOIN u USING (status) GROUP BY status""")
def a03(t: Tables) -> DataFrame:
    return metrics.sources_by_status(units(t), statuses(t))


@query("a04_units_by_status", f"""
WITH u AS (SELECT {STATUS_SQL} AS status, user_id FROM events), s(status) AS (VALUES {STATUS_ROWS})
SELECT status, count(user_id) AS n_rows FROM s LEFT JOIN u USING (status) GROUP BY status""")
def a04(t: Tables) -> DataFrame:
    return metrics.by_status(units(t), statuses(t))


JOBS = """
j AS (SELECT o_orderkey AS job_id, o_orderstatus AS job_status, o_orderpriority AS priority, epoch_ms(o_orderdate) AS created_at,
  (SELECT max(epoch_ms(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey) AS finished_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS batch_id,
  CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)"""


def jobs(t: Tables) -> DataFrame:
    ended = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max(millis("l_shipdate")).alias("finished_at"))
    price = F.floor("o_totalprice").cast("bigint")
    own = t.orders.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("job_status"), F.col("o_orderpriority").alias("priority"), millis("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("batch_id"),
        price.alias("input_tokens"), F.expr("CAST(floor(o_totalprice) AS BIGINT) div 2").alias("cached_tokens"), F.lit(None).cast("bigint").alias("cache_write_tokens"), (price % 1000).alias("output_tokens"), F.when(F.col("o_orderkey") % 2 == 0, price % 100).alias("reasoning_tokens"),
    )
    return own.join(ended, "job_id", "left")


@query("a05_durations", f"WITH {JOBS} SELECT job_status, coalesce(CAST(trunc(avg(finished_at - created_at)) AS BIGINT), 0) AS avg_ms, coalesce(min(finished_at - created_at), 0) AS min_ms, coalesce(max(finished_at - created_at), 0) AS max_ms FROM j GROUP BY job_status")
def a05(t: Tables) -> DataFrame:
    return metrics.durations(jobs(t), "job_status")


TOKEN_SUMS = "CAST(sum(p) AS BIGINT) AS input_tokens, CAST(sum(p // 2) AS BIGINT) AS cached_tokens, 0 AS cache_write_tokens, CAST(sum(p % 1000) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN job_id % 2 = 0 THEN p % 100 ELSE 0 END) AS BIGINT) AS reasoning_tokens"
MODE = "CASE WHEN batch_id IS NULL THEN 'realtime' ELSE 'batch' END AS mode"


@query("a06_tokens_by_status", f"WITH {JOBS} SELECT job_status, {TOKEN_SUMS} FROM j GROUP BY job_status")
def a06(t: Tables) -> DataFrame:
    return metrics.tokens(jobs(t), "job_status")


@query("a07_tokens_by_mode", f"WITH {JOBS} SELECT {MODE}, {TOKEN_SUMS} FROM j GROUP BY 1")
def a07(t: Tables) -> DataFrame:
    return metrics.tokens_by_mode(jobs(t))


@query("a16_cost", f"""
WITH {JOBS}, s AS (SELECT {MODE}, {TOKEN_SUMS} FROM j GROUP BY 1)
SELECT mode, round((input_tokens * 0.5 + cached_tokens * 0.05 + cache_write_tokens * 0.625 + (output_tokens + reasoning_tokens) * 2.0) / 1000000 * CASE mode WHEN 'batch' THEN 0.5 ELSE 1 END, 6) AS cost FROM s""")
def a16(t: Tables) -> DataFrame:
    rates = t.spark.createDataFrame([(0.5, 0.05, 0.625, 2.0, 0.5)], "input_rate double, cached_rate double, cache_write_rate double, output_rate double, batch_discount double")
    return metrics.cost(metrics.tokens_by_mode(jobs(t)), rates).withColumn("cost", F.round("cost", 6))


@query("a09_step_seconds", f"WITH {JOBS} SELECT priority AS step_name, round(sum(finished_at - created_at) / 1000, 3) AS seconds FROM j GROUP BY 1")
def a09(t: Tables) -> DataFrame:
    runs = jobs(t).select(F.col("priority").alias("step_name"), (F.col("finished_at") - F.col("created_at")).alias("duration_ms"))
    return metrics.step_seconds(runs).withColumn("seconds", F.round("seconds", 3))


@query("a10_wall_clock", f"WITH {JOBS} SELECT min(created_at) AS first_ms, max(finished_at) AS last_ms, count(*) FILTER (WHERE job_status <> 'F') AS not_completed, count(*) AS n_jobs FROM j")
def a10(t: Tables) -> DataFrame:
    return metrics.wall_clock(jobs(t).withColumn("job_status", F.when(F.col("job_status") == "F", "COMPLETED").otherwise(F.col("job_status"))))


@query("a15_stats_rollup", f"WITH {JOBS} SELECT job_status, priority, count(*) AS n_rows FROM j GROUP BY ROLLUP (job_status, priority)")
def a15(t: Tables) -> DataFrame:
    return metrics.rollup_counts(jobs(t), "job_status", "priority")


@query("a17_ratios", "SELECT o_custkey AS source, round(coalesce(count(*) / nullif(count(DISTINCT l_partkey), 0), 0), 6) AS mentions_per_object, round(coalesce(count(DISTINCT l_partkey) / nullif(count(DISTINCT o_orderkey), 0), 0), 6) AS objects_per_chunk FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def a17(t: Tables) -> DataFrame:
    n = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("m"), F.count_distinct("l_partkey").alias("o"), F.count_distinct("o_orderkey").alias("c"))
    return n.select("source", F.round(metrics.ratio(F.col("m"), F.col("o")), 6).alias("mentions_per_object"), F.round(metrics.ratio(F.col("o"), F.col("c")), 6).alias("objects_per_chunk"))


@query("a18_weighted_duration", f"WITH {JOBS}, s AS (SELECT job_status, CAST(trunc(avg(finished_at - created_at)) AS BIGINT) AS a, count(*) AS n FROM j WHERE finished_at IS NOT NULL GROUP BY 1) SELECT round(sum(a * n) / sum(n), 3) AS avg_ms FROM s")
def a18(t: Tables) -> DataFrame:
    done = jobs(t).where("finished_at IS NOT NULL")
    parts = metrics.durations(done, "job_status").join(done.groupBy("job_status").agg(F.count("*").alias("n")), "job_status")
    return metrics.weighted_average(parts).withColumn("avg_ms", F.round("avg_ms", 3))


@query("t03_retry_policy", f"""
WITH u AS (SELECT event_id, {STATUS_SQL} AS status, 1 + event_id % 5 AS attempts, user_id % 4 AS failed, CAST(props ->> '$.k' AS BIGINT) AS k FROM events),
o AS (SELECT *, k % 5 = 0 AS ok, ['NONE', 'DEFERRED', 'DEFERRED_UNCOUNTED', 'IMMEDIATE'][k % 4 + 1] AS p, status = 'IN_PROGRESS' AND k % 7 <> 0 AS run FROM u),
f AS (SELECT *, failed + CASE WHEN run AND NOT ok AND p = 'IMMEDIATE' THEN 1 ELSE 0 END AS nf FROM o)
SELECT event_id, attempts - CASE WHEN run AND NOT ok AND p = 'DEFERRED_UNCOUNTED' THEN 1 ELSE 0 END AS attempts, nf AS failed,
  CASE WHEN NOT run THEN status WHEN ok THEN 'COMPLETED' WHEN p = 'DEFERRED_UNCOUNTED' THEN 'RETRY' WHEN p = 'NONE' THEN 'FAILED' WHEN nf > 2 OR attempts >= 5 THEN 'FAILED' WHEN p = 'DEFERRED' THEN 'RETRY' ELSE 'PENDING' END AS status
FROM f""")
def t03(t: Tables) -> DataFrame:
    rows = units(t).withColumns({"attempts": 1 + F.col("event_id") % 5, "failed": F.col("context_id") % 4, "last_error": F.lit(None).cast("string")})
    policies = F.array(*map(F.lit, ("NONE", "DEFERRED", "DEFERRED_UNCOUNTED", "IMMEDIATE")))
    outcomes = units(t).where("k % 7 <> 0").select("event_id", (F.col("k") % 5 == 0).alias("ok"), F.get(policies, (F.col("k") % 4).cast("int")).alias("policy"), F.lit("broken").alias("error"))
    return lifecycle.resolve(rows, outcomes, ["event_id"]).select("event_id", "status", "attempts", "failed")


@query("t05_recovery", f"""
WITH u AS (SELECT event_id, user_id, {STATUS_SQL} AS status, 1 + event_id % 5 AS attempts FROM events),
l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND CAST(props ->> '$.k' AS BIGINT) > 97)
SELECT event_id, CASE WHEN status = 'RETRY' OR status = 'IN_PROGRESS' AND l.user_id IS NOT NULL THEN 'PENDING' ELSE status END AS status,
  attempts - CASE WHEN status = 'IN_PROGRESS' AND l.user_id IS NOT NULL THEN 1 ELSE 0 END AS attempts FROM u LEFT JOIN l USING (user_id)""")
def t05(t: Tables) -> DataFrame:
    rows = units(t).withColumn("attempts", 1 + F.col("event_id") % 5)
    running = units(t).select("context_id", F.col("status").alias("job_status"), F.when(F.col("k") <= 97, F.col("k")).alias("batch_id"))
    return lifecycle.recover(rows, running, ["context_id"])[0].select("event_id", "status", "attempts")


@query("t06_overdue_batches", """
WITH b AS (SELECT event_id AS batch_id, event_type, epoch_ms(ts) AS created_at FROM events), n AS (SELECT max(created_at) AS now FROM b)
SELECT batch_id, CASE WHEN (now - created_at) / 3600000 >= 26 THEN 'discard' ELSE 'cancel' END AS action FROM b, n WHERE event_type IN ('view', 'click') AND (now - created_at) / 3600000 >= 25""")
def t06(t: Tables) -> DataFrame:
    batches = t.events.select(F.col("event_id").alias("batch_id"), F.when(F.col("event_type") == "view", "SUBMITTED").when(F.col("event_type") == "click", "IN_PROGRESS").otherwise("COMPLETED").alias("batch_status"), millis("ts").alias("created_at"))
    now = batches.agg(F.max("created_at").alias("n")).first()["n"] or 0
    return lifecycle.overdue(batches, now).select("batch_id", "action")


@query("t09_addition_conflicts", """
WITH a AS (SELECT DISTINCT o_custkey AS document, o_orderstatus AS lv, o_orderpriority AS ty FROM orders WHERE o_orderstatus <> 'F'),
b AS (SELECT DISTINCT o_custkey AS document, o_orderstatus AS lv, o_orderpriority AS ty FROM orders)
SELECT document, count(*) AS n_gained FROM b WHERE document IN (SELECT document FROM a) AND (document, lv, ty) NOT IN (SELECT document, lv, ty FROM a) GROUP BY document""")
def t09(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("document"), F.col("o_orderstatus").alias("context_level"), F.col("o_orderpriority").alias("entity_type_name"))
    return planning.added_conflicts(rows.where("context_level <> 'F'"), rows, "document")


@query("o03_claim_batch", f"""
WITH u AS (SELECT event_id, user_id, {STATUS_SQL} AS status FROM events), c AS (SELECT DISTINCT user_id FROM u WHERE status = 'PENDING' ORDER BY user_id LIMIT 100)
SELECT event_id, 'IN_PROGRESS' AS status, 1 AS attempts FROM u WHERE status = 'PENDING' AND user_id IN (SELECT user_id FROM c)""")
def o03(t: Tables) -> DataFrame:
    rows = units(t).withColumns({"context_level": F.lit("CHUNK"), "attempts": F.lit(0), "last_error": F.lit(None).cast("string")})
    return lifecycle.claim(rows, 100).select("event_id", "status", "attempts")


@query("j20_results_of_jobs", """
SELECT o_orderkey AS job_id, CASE WHEN l.k IS NULL THEN 'MISSING' WHEN l.n > 1 THEN 'COMPLETED' ELSE 'FAILED' END AS outcome
FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON l.k = o_orderkey""")
def j20(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n"))
    results = n.select("job_id", F.when(F.col("n") > 1, "{}").alias("content"), F.when(F.col("n") == 1, "transient").alias("error_class"))
    return lifecycle.matched_results(t.orders.select(F.col("o_orderkey").alias("job_id")), results).select("job_id", "outcome")


@query("x09_error_policies", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'DEFERRED_UNCOUNTED' WHEN 'click' THEN 'DEFERRED' WHEN 'error' THEN 'IMMEDIATE' ELSE 'NONE' END AS policy FROM events""")
def x09(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "transient").when(F.col("event_type") == "click", "timeout").when(F.col("event_type") == "error", "response").when(F.col("event_type") == "signup", "internal").otherwise("other")
    return t.events.select("event_id", lifecycle.policy_of(kind).alias("policy"))


@query("w04_last_errors", "SELECT user_id AS context_id, max_by(event_type, event_id) AS last_error, count(*) AS n_attempts FROM events GROUP BY 1")
def w04(t: Tables) -> DataFrame:
    return lifecycle.last_errors(t.events.select(F.col("user_id").alias("context_id"), F.col("event_type").alias("error"), F.col("event_id").alias("attempt")), ["context_id"])


@query("o04_keyset_page", "SELECT o_orderkey, epoch_ms(o_orderdate) AS created_at FROM orders WHERE (epoch_ms(o_orderdate), o_orderkey) > (852076800000, 100) ORDER BY 2, 1 LIMIT 50")
def o04(t: Tables) -> DataFrame:
    rows = t.orders.select(millis("o_orderdate").alias("created_at"), "o_orderkey")
    return ordering.page(rows, ["created_at", "o_orderkey"], (852076800000, 100), 50)


@query("o06_hash_shuffle", "SELECT doc_id, sha256('7:docs:' || doc_id) AS shuffle_key FROM documents")
def o06(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ordering.shuffled_key(7, "docs", F.col("doc_id")).alias("shuffle_key"))


@query("o07_prefix_sample", "SELECT doc_id FROM documents ORDER BY sha256('7:docs:' || doc_id), doc_id LIMIT 100")
def o07(t: Tables) -> DataFrame:
    return ordering.sample(t.documents.select("doc_id"), "doc_id", 100, 7, "docs")


@query("w05_smoothed_rates", "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, x: 0.3 * x + 0.7 * a), 6) AS smoothed FROM events GROUP BY user_id")
def w05(t: Tables) -> DataFrame:
    return ordering.smoothed(t.events, "user_id", "event_id", "value").withColumn("smoothed", F.round("smoothed", 6))


@query("w06_progress_rates", """
SELECT event_id, round((value - lag(value) OVER w) * 60.0 / nullif(epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER w, 0), 6) AS per_minute
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id)""")
def w06(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "value", F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, cast(ts AS timestamp_ntz)) div 1000").alias("second"))
    return ordering.rates(rows, "user_id", "second", "value", "event_id").select("event_id", F.round("per_minute", 6).alias("per_minute"))


@query("a28_worst_groups", "SELECT p_brand, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS total, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 9) AS share FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand ORDER BY 2 / 3.0, count(*) FILTER (WHERE l_returnflag = 'R') / count(*), total DESC, p_brand LIMIT 8")
def a28(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("total"))
    return ordering.top_by_ratio(rows, "returned", "total", 8).withColumn("share", F.round("share", 9))


@query("a29_first_values", """
WITH s AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS position FROM s)
SELECT user_id, event_type, position FROM r WHERE position <= 3""")
def a29(t: Tables) -> DataFrame:
    return ordering.first_values(t.events, "user_id", "event_type", "event_id", 3)
