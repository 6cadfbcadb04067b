"""The life of a unit of work: planned, claimed, done, tried again, failed; and of jobs and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of failures and attempts, and hours after which a batch is cancelled and then discarded.
MAX_FAILED, MAX_ATTEMPTS = 2, 5
CANCEL_HOURS, DISCARD_HOURS = 25, 26
#: Hours for which a service keeps results.
RETENTION_HOURS = 30 * 24
#: Retry policy and severity of each class of error.
ERROR_POLICY = {"transient": "DEFERRED_UNCOUNTED", "timeout": "DEFERRED", "response": "IMMEDIATE", "truncated": "DEFERRED", "config": "NONE", "internal": "NONE"}


def policy_of(error_class):
    pairs = F.create_map(*[F.lit(x) for pair in ERROR_POLICY.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, error_class), F.lit("NONE"))


UNIT = "status string, attempts int, failed int, last_error string"


def planned(units: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """The stored units, and those that are new as pending ones."""
    state = [F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("failed"), F.lit(None).cast("string").alias("last_error")]
    if stored is None:
        return units.select(*keys, *state).distinct()
    new = units.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(new.select(*keys, *state))


def claim(units: DataFrame, most: int | None = 1000) -> DataFrame:
    """Pending units of the first `most` contexts (of all without it): in progress, an attempt more, their error cleared."""
    taken = units.where("status = 'PENDING'")
    if most:
        contexts = taken.select("context_level", "context_id").distinct().orderBy("context_level", "context_id").limit(most)
        taken = taken.join(contexts, ["context_level", "context_id"], "left_semi")
    return taken.withColumns({"status": F.lit("IN_PROGRESS"), "attempts": F.col("attempts") + 1, "last_error": F.lit(None).cast("string")})


def outcomes(jobs: DataFrame) -> DataFrame:
    """job_id, ok, policy and error of answered jobs (content, error_class, decoded: whether the content could be read)."""
    error = F.when(F.col("content").isNull(), F.coalesce("error_class", F.lit("transient"))).when(~F.col("decoded"), "response")
    return jobs.select("job_id", error.isNull().alias("ok"), F.when(error.isNotNull(), policy_of(error)).alias("policy"), error.alias("error"))


def progress(units: DataFrame) -> DataFrame:
    """Units by status."""
    return units.groupBy("status").agg(F.count("*").alias("n_units"), F.sum("attempts").alias("attempts"))


def resolve(units: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Units in progress after their outcomes (keys, ok, policy, error); all others stay as they are."""
    told = units.join(outcomes.select(*keys, "ok", "policy", "error"), keys, "left")
    running = (F.col("status") == "IN_PROGRESS") & F.col("ok").isNotNull()
    p = F.coalesce("policy", F.lit("NONE"))
    failed = F.col("failed") + F.when(running & ~F.col("ok") & (p == "IMMEDIATE"), 1).otherwise(0)
    over = (failed > MAX_FAILED) | (F.col("attempts") >= MAX_ATTEMPTS)
    status = (
        F.when(~running, F.col("status"))
        .when(F.col("ok"), "COMPLETED")
        .when(p == "DEFERRED_UNCOUNTED", "RETRY")
        .when(p == "DEFERRED", F.when(over, "FAILED").otherwise("RETRY"))
        .when(p == "IMMEDIATE", F.when(over, "FAILED").otherwise("PENDING"))
        .otherwise("FAILED")
    )
    attempts = F.col("attempts") - F.when(running & ~F.col("ok") & (p == "DEFERRED_UNCOUNTED"), 1).otherwise(0)
    error = F.when(running & ~F.col("ok"), F.col("error")).when(running, F.lit(None)).otherwise(F.col("last_error"))
    return told.withColumns({"status": status, "attempts": attempts, "failed": failed, "last_error": error}).drop("ok", "policy", "error")


def recover(units: DataFrame, jobs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """At the start of a run: jobs in progress without a batch have failed, their units are pending with the attempt given back, and
    those that wait for a retry are pending."""
    stalled = jobs.where("job_status = 'IN_PROGRESS' AND batch_id IS NULL")
    lost = stalled.select(*keys).distinct().withColumn("_lost", F.lit(True))
    told = units.join(lost, keys, "left")
    hit = F.col("_lost").isNotNull() & (F.col("status") == "IN_PROGRESS")
    back = told.withColumns({"attempts": F.col("attempts") - F.when(hit, 1).otherwise(0), "status": F.when(hit | (F.col("status") == "RETRY"), "PENDING").otherwise(F.col("status"))}).drop("_lost")
    ended = jobs.withColumn("job_status", F.when((F.col("job_status") == "IN_PROGRESS") & F.col("batch_id").isNull(), "FAILED").otherwise(F.col("job_status")))
    return back, ended


def overdue(batches: DataFrame, now_ms: int) -> DataFrame:
    hours = (F.lit(now_ms) - F.col("created_at")) / 3_600_000
    action = F.when(hours >= DISCARD_HOURS, "discard").when(hours >= CANCEL_HOURS, "cancel")
    return batches.where(F.col("batch_status").isin("SUBMITTED", "IN_PROGRESS")).withColumn("action", action).where("action IS NOT NULL")


def batch_action(status: str | None, hours: float) -> str:
    """What to do with a batch of that age, by its service's status: SUBMITTED, IN_PROGRESS, an end, or none if the service can't be reached."""
    if status is None:  # its results may be there, so it isn't given up before they can't be any more
        return "discard" if hours >= RETENTION_HOURS else "wait"
    if status not in ("SUBMITTED", "IN_PROGRESS"):
        return "collect"
    return "discard" if hours >= DISCARD_HOURS else "cancel" if hours >= CANCEL_HOURS else "wait"


def open_batches(batches: DataFrame, level: str | None = None) -> DataFrame:
    """Batches that are submitted or under way, of a level if one is given."""
    rows = batches.where(F.col("batch_status").isin("SUBMITTED", "IN_PROGRESS"))
    return rows if level is None else rows.where(F.col("context_level").isNull() | (F.col("context_level") == level))


def with_jobs(batches: DataFrame, jobs: DataFrame, key: str = "batch_id") -> DataFrame:
    """Batches that some job belongs to."""
    return batches.join(jobs.select(key), key, "left_semi")


def status_report(chunks: DataFrame, units: DataFrame, status: str, document: str, chunk: str) -> DataFrame:
    """Documents, chunks and units by status, chunks without units included."""
    n = units.groupBy(chunk).agg(F.count("*").alias("_units"))
    joined = chunks.join(n, chunk, "left").groupBy(status)
    return joined.agg(F.count_distinct(document).alias("n_documents"), F.count("*").alias("n_chunks"), F.sum(F.coalesce("_units", F.lit(0))).alias("n_units"))


def matched_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Every job with its result; one without is to be tried again."""
    outcome = F.when(F.col("content").isNotNull(), "COMPLETED").when(F.col("error_class").isNotNull(), "FAILED").otherwise("MISSING")
    return jobs.join(results, "job_id", "left").withColumn("outcome", outcome)


def last_errors(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.max_by("error", "attempt").alias("last_error"), F.count("*").alias("n_attempts"))


# What stands behind what.
STEPS = ("INGEST_DOCUMENTS", "EXTRACT_ENTITIES", "EXTRACT_RELATIONSHIPS", "EXPORT_KNOWLEDGE")
NEEDS = {"INGEST_DOCUMENTS": (), "EXTRACT_ENTITIES": ("INGEST_DOCUMENTS",), "EXTRACT_RELATIONSHIPS": ("EXTRACT_ENTITIES",), "EXPORT_KNOWLEDGE": ("EXTRACT_RELATIONSHIPS",)}


def from_step(step: str) -> list[str]:
    """The step and all that depend on it, which a reset clears."""
    out = [step]
    for other in STEPS:
        if other not in out and any(n in out for n in NEEDS[other]):
            out.append(other)
    return out


def next_step(done: set[str]) -> str | None:
    return next((s for s in STEPS if s not in done and all(n in done for n in NEEDS[s])), None)


def snapshot_state(stored: dict | None, now: dict) -> str:
    """How an input compares with what an earlier run saw: NEW, CURRENT, EXTENDED by entries, or OUTDATED."""
    if stored is None:
        return "NEW"
    if stored == now:
        return "CURRENT"
    return "EXTENDED" if all(k in now and now[k] == v for k, v in stored.items()) else "OUTDATED"
