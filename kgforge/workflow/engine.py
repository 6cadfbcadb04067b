"""Documents to graph, step by step, in a workspace of versioned datasets.

Every step reads the datasets of the steps before and adds to its own; one that is done is not run again until it is reset or documents
are added. What is looked for in a context is a unit, which is asked for once: units are planned, claimed, answered in a job, and then
completed, tried again in this run or the next, or given up, by the class of the error. So a run over more documents chunks and asks for
what is new alone, and a run after one that broke off goes on where it ended. Objects of new mentions are merged into those stored.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgforge.functions import identity
from kgforge.functions.text import normalize_text
from kgforge.model.loader import load_model, load_registry, load_settings
from kgforge.operators import chunking, lifecycle, materialize, planning, relationships
from kgforge.sinks import graph, storage
from kgforge.sources import files

from . import remote
from .extractors import RESPONSE, Extractor, entity_prompt, prompts, relationship_prompt

SKELETON = {
    "knowledge_model.json": {"extraction_config": {"llm": {"domain": "", "language": None}, "projection": {"enabled_entities": None, "enabled_relationships": None}}, "entity_types": {}, "relationship_types": {}},
    "document_collections.json": {"collections": {}},
}
DATASETS = {
    "INGEST_DOCUMENTS": ("documents", "memberships", "chunks"),
    "EXTRACT_ENTITIES": ("entity_units", "entity_units_batched", "entity_jobs", "entity_mentions", "entities", "entity_provenance"),
    "EXTRACT_RELATIONSHIPS": ("relationship_units", "relationship_units_batched", "relationship_jobs", "relationship_mentions", "relationships", "relationship_provenance"),
    "EXPORT_KNOWLEDGE": (),
}
#: The units of a step that extracts.
UNITS = {"EXTRACT_ENTITIES": "entity_units", "EXTRACT_RELATIONSHIPS": "relationship_units"}


class Unfinished(RuntimeError):
    """Some units wait for the next run."""


class Workspace:
    """A folder on any store that Spark reaches; path is a local one's."""

    def __init__(self, path: str) -> None:
        self.root = str(path).rstrip("/")
        self.path = storage.local(self.root) if storage.is_local(self.root) else None

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def init(self) -> list[str]:
        """Writes the input files that aren't there."""
        made = self.missing()
        for name in made:
            storage.write_text(self.at(name), json.dumps(SKELETON[name], indent=2) + "\n")
        return made

    def missing(self) -> list[str]:
        return [n for n in SKELETON if not storage.exists(self.at(n))]

    def dataset(self, name: str) -> graph.Versions:
        return graph.Versions(self.at(f"datasets/{name}"))

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        return self.dataset(name).read(spark)

    def state(self) -> dict:
        text = storage.read_text(self.at("state.json"))
        return json.loads(text) if text else {"done": [], "runs": [], "inputs": None}

    def save(self, state: dict) -> None:
        graph.write_stats(state, self.at("state.json"))

    def reset(self, step: str = lifecycle.STEPS[0]) -> list[str]:
        """Clears a step and all that follow from it."""
        steps = lifecycle.from_step(step)
        for s in steps:
            for name in DATASETS[s]:
                self.dataset(name).clear()
        state = self.state()
        state["done"] = [s for s in state["done"] if s not in steps]
        # batches that are under way are no longer this workspace's
        state["batches"] = [b for b in state.get("batches", []) if b["step"] not in steps]
        if step == lifecycle.STEPS[0]:
            state["inputs"] = None
        self.save(state)
        return steps

    def status(self, spark: SparkSession | None = None) -> dict:
        """State, next step and, with a session, how far the units of each step are and how many seconds the rest will take."""
        state = self.state()
        out = {"done": state["done"], "next": lifecycle.next_step(set(state["done"])), "runs": state["runs"], "steps": {}}
        for step, name in UNITS.items():
            units = self.read(spark, name) if spark else None
            if units is not None:
                by = {r["status"]: r["n_units"] for r in lifecycle.progress(units).collect()}  # a row a status
                resolved, total = by.get("COMPLETED", 0) + by.get("FAILED", 0), sum(by.values())
                spent = sum(r["duration_ms"] for r in state["runs"] if r["step"] == step) / 1000
                out["steps"][step] = {"units": by, "resolved": resolved, "total": total, "seconds_left": round(spent / resolved * (total - resolved), 1) if resolved else None}
        return out


class Engine:
    """extractor answers requests at once; with a service they go out in batches, which a later run collects."""

    def __init__(self, spark: SparkSession, workspace: Workspace, data: str, extractor: Extractor | None, settings: str | None = None, service: remote.Service | None = None, now: Callable[[], float] = time.time) -> None:
        if missing := workspace.missing():
            raise FileNotFoundError(f"the workspace lacks {', '.join(missing)}")
        self.spark, self.workspace, self.data, self.extractor, self.service, self.now = spark, workspace, data, extractor, service, now
        self.model, self.registry = load_model(workspace.at("knowledge_model.json")), load_registry(workspace.at("document_collections.json"))
        self.settings = load_settings(settings)
        self.inputs = {n: json.loads(storage.read_text(workspace.at(n))) for n in SKELETON}

    # tables of the model: a row a declared type or pair
    def _types(self) -> DataFrame:
        return self.spark.createDataFrame(self.model.type_rows(), "context_level string, entity_type_name string, collection_name string")

    def _endpoints(self) -> DataFrame:
        return planning.both_ways(self.spark.createDataFrame(self.model.endpoint_rows(), "relationship_type_name string, source_type string, target_type string, source_level string, target_level string, symmetric boolean"))

    def _write(self, name: str, rows: DataFrame) -> DataFrame:
        self.workspace.dataset(name).write(rows)
        return self.workspace.read(self.spark, name)

    def check(self) -> list[str]:
        """Warnings; raises for what can't be run."""
        known = set(self.registry)
        if wrong := sorted({c for _, _, c in self.model.type_rows()} - known):
            raise ValueError(f"no collection {', '.join(wrong)}")
        files.check_sources([s for sources in self.registry.values() for s in sources], self.data)
        state = self.workspace.state()
        if state["inputs"] and state["done"]:
            model = lifecycle.snapshot_state(state["inputs"]["knowledge_model.json"], self.inputs["knowledge_model.json"])
            if model != "CURRENT":
                raise ValueError("the model has changed since the last run: reset first")
            if lifecycle.snapshot_state(state["inputs"]["document_collections.json"]["collections"], self.inputs["document_collections.json"]["collections"]) == "OUTDATED":
                raise ValueError("a collection has changed since the last run: reset first, or only add to it")
        return self.model.warnings()

    # steps
    def ingest(self) -> None:
        scanned = files.scan_registry(self.spark, self.data, self.registry)
        new = scanned.groupBy("content_id").agg(F.min("source_uri").alias("source_uri"), F.min_by("text", "source_uri").alias("text"))
        old, links = self.workspace.read(self.spark, "chunks"), scanned.select("content_id", "collection_name").distinct()
        stored = self.workspace.read(self.spark, "documents")
        if stored is not None and old is not None:  # documents only ever come in; what is there stays as it is, with its chunks
            new = new.join(stored.select("content_id"), "content_id", "left_anti")
            known = self.workspace.read(self.spark, "memberships")
            links = links.join(known, links.columns, "left_anti")
        c = self.settings["chunking"]
        self.workspace.dataset("memberships").append(links)
        self.workspace.dataset("chunks").append(chunking.chunks(new, chunking.Plan(c["target"], c["overlap"], c["limit"], c["tokenizer"])))
        # last: a document that is there has its chunks; one without was cut off before, and gets the same again
        self.workspace.dataset("documents").append(new)

    def contexts(self) -> DataFrame:
        """context_level, context_id, document, collection_name and text of all contexts."""
        documents, chunks, links = (self.workspace.read(self.spark, n) for n in ("documents", "chunks", "memberships"))
        most = self.settings["pipeline"]["document_tokens"]
        head = chunking.first_tokens_of(normalize_text(F.col("text")), most, self.settings["chunking"]["tokenizer"])
        whole = documents.select(F.lit("DOCUMENT").alias("context_level"), F.col("content_id").alias("context_id"), F.col("content_id").alias("document"), F.lit(-1).alias("chunk_index"), head.alias("text"))
        parts = chunks.select(F.lit("CHUNK").alias("context_level"), F.col("chunk_id").alias("context_id"), F.col("content_id").alias("document"), "chunk_index", F.col("content").alias("text"))
        return whole.unionByName(parts).join(links.withColumnRenamed("content_id", "document"), "document")

    KEYS = {"EXTRACT_ENTITIES": ["context_level", "context_id", "entity_type_name"], "EXTRACT_RELATIONSHIPS": ["context_level", "context_id", "relationship_type_name"]}

    def entity_units(self) -> DataFrame:
        contexts = self.contexts()
        at = lambda level: planning.units(contexts.where(F.col("context_level") == level), self._types(), level)
        return lifecycle.planned(at("DOCUMENT").unionByName(at("CHUNK")), self.workspace.read(self.spark, "entity_units"), self.KEYS["EXTRACT_ENTITIES"])

    def entity_requests(self, units: DataFrame) -> DataFrame:
        """A request a context, for the types of its units."""
        texts = self.contexts().select("context_level", "context_id", "text").dropDuplicates(["context_level", "context_id"])
        asked = planning.requests(units).join(texts, ["context_level", "context_id"])
        none = F.array().cast("array<struct<temp_id:string,entity_type_name:string,name:string>>")
        return prompts(self._numbered(asked, units, "entities").withColumn("candidates", none), entity_prompt(self.model))

    def _numbered(self, asked: DataFrame, units: DataFrame, task: str) -> DataFrame:
        """With job_id, by task, context, types and attempt, so that another try is another job."""
        tries = units.groupBy("context_level", "context_id").agg(F.max("attempts").alias("attempt"))
        parts = [F.lit(task), F.col("context_level"), F.col("context_id"), F.array_join("types", ","), F.col("attempt").cast("string")]
        return asked.join(tries, ["context_level", "context_id"]).withColumns({"task": F.lit(task), "job_id": identity.composed(*parts)}).drop("attempt")

    def _work_off(self, step: str, plan: Callable[[], DataFrame], ask: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], None]) -> None:
        """Plans and claims the step's units, asks for them and keeps what is answered, until none is pending."""
        dataset, keys, jobs_name = self.workspace.dataset(UNITS[step]), self.KEYS[step], UNITS[step].replace("units", "jobs")
        waiting = self._collect(step, jobs_name, keep)
        # what was under way when a run broke off, or waits for another try, is pending again
        jobs = plan().where("status = 'IN_PROGRESS'").select(*keys, F.lit("IN_PROGRESS").alias("job_status"))
        jobs = jobs.join(waiting.select("context_level", "context_id", "batch_id").distinct(), ["context_level", "context_id"], "left") if waiting is not None else jobs.withColumn("batch_id", F.lit(None).cast("string"))
        dataset.write(lifecycle.recover(plan(), jobs, keys)[0])
        while True:
            units = dataset.read(self.spark)
            taken = lifecycle.claim(units, self.settings["pipeline"]["claim"])
            if not taken.limit(1).count():
                break
            before = units.where("status = 'IN_PROGRESS'").select(*keys)
            dataset.write(units.join(taken.select(*keys), keys, "left_anti").unionByName(taken))
            # units of a context that is under way in a batch wait with it; the others are asked for now
            taken = dataset.read(self.spark).where("status = 'IN_PROGRESS'").join(before, keys, "left_anti")
            requests = ask(taken)
            if self.service:
                self._submit(step, requests)
            else:
                self._answered(step, jobs_name, requests.drop("prompt", "text"), self.extractor(requests), keep)
        left = dataset.read(self.spark).where("status IN ('RETRY', 'IN_PROGRESS')").count()
        if left:
            raise Unfinished(f"{step}: {left} units wait for another run")

    def _answered(self, step: str, jobs_name: str, requests: DataFrame, responses: DataFrame, keep: Callable[[DataFrame], None]) -> None:
        """Keeps what the responses to the requests say, and resolves their units."""
        dataset = self.workspace.dataset(UNITS[step])
        answered = materialize.decoded(requests.join(responses, "job_id", "left"))
        self.workspace.dataset(jobs_name).append(answered.withColumn("claimed", F.lit(self._claims(jobs_name))))
        mine = self.workspace.read(self.spark, jobs_name).where(F.col("claimed") == self._claims(jobs_name) - 1)
        keep(mine.where("decoded"))
        told = mine.select("job_id", "context_level", "context_id").join(lifecycle.outcomes(mine), "job_id").drop("job_id")
        dataset.write(lifecycle.resolve(dataset.read(self.spark), told, ["context_level", "context_id"]))

    def _submit(self, step: str, requests: DataFrame) -> None:
        """Hands the requests to the service as a batch, whose jobs are noted before it has them."""
        batch = uuid.uuid4().hex
        path = self.workspace.at(f"batches/{batch}")
        self.workspace.dataset(f"{UNITS[step]}_batched").append(requests.drop("prompt", "text").withColumn("batch_id", F.lit(batch)))
        remote.write_batch(requests, storage.uri(path))
        state = self.workspace.state()
        state.setdefault("batches", []).append({"batch_id": batch, "step": step, "name": self.service.submit(path), "created_at": self.now(), "status": "SUBMITTED"})
        self.workspace.save(state)

    def _collect(self, step: str, jobs_name: str, keep: Callable[[DataFrame], None]) -> DataFrame | None:
        """Collects the step's batches that have ended and ends those that are overdue; returns the jobs of those still under way."""
        batched = self.workspace.read(self.spark, f"{UNITS[step]}_batched")
        for batch in [b for b in self.workspace.state().get("batches", []) if b["step"] == step and b["status"] in ("SUBMITTED", "IN_PROGRESS")]:
            status, error = None, None
            try:
                status = self.service.status(batch["name"]) if self.service else None
            except OSError as e:
                error = str(e)
            action = lifecycle.batch_action(status, (self.now() - batch["created_at"]) / 3600)
            jobs = batched.where(F.col("batch_id") == batch["batch_id"]).drop("batch_id")
            none = self.spark.createDataFrame([], RESPONSE)
            if action == "cancel":
                self.service.cancel(batch["name"])
            elif action == "collect":
                path = self.service.results(batch["name"])
                # what is missing is asked for again
                self._answered(step, jobs_name, jobs, remote.read_batch(self.spark, storage.uri(path)) if path else none, keep)
            elif action == "discard":
                self._answered(step, jobs_name, jobs, none, keep)
            now = {"discard": "CANCELLED", "collect": status}.get(action, status or batch["status"])
            state = self.workspace.state()
            state["batches"] = [b | {"status": now, "error": error} if b["batch_id"] == batch["batch_id"] else b for b in state["batches"]]
            self.workspace.save(state)
        under_way = [b["batch_id"] for b in self.workspace.state().get("batches", []) if b["step"] == step and b["status"] in ("SUBMITTED", "IN_PROGRESS")]
        return batched.where(F.col("batch_id").isin(under_way)) if under_way else None

    def _claims(self, jobs_name: str) -> int:
        """How many claims have been answered so far."""
        jobs = self.workspace.read(self.spark, jobs_name)
        return 0 if jobs is None else jobs.agg(F.max("claimed")).first()[0] + 1 if jobs.limit(1).count() else 0

    def _merge(self, kind: str, mentions: DataFrame, types: list, carried: tuple[str, ...] = ()) -> None:
        """Adds the mentions and merges them into the stored objects."""
        key, type_name, objects = f"{kind}_id", f"{kind}_type_name", {"entity": "entities", "relationship": "relationships"}[kind]
        made = self.workspace.dataset(f"{kind}_mentions")
        # a claim that was kept before a run broke off is not kept twice
        known = made.read(self.spark)
        new = mentions if known is None else mentions.join(known.select("job_id", "item", key), ["job_id", "item", key], "left_anti")
        before = made.parts()
        made.append(new)
        new = self.spark.read.parquet(*[storage.uri(p) for p in made.parts() if p not in before]) if len(made.parts()) > len(before) else new
        self._write(objects, materialize.merged(new, types, key, type_name, carried, self.workspace.read(self.spark, objects)))
        links, old = materialize.provenance(new, key), self.workspace.read(self.spark, f"{kind}_provenance")
        self.workspace.dataset(f"{kind}_provenance").append(links if old is None else links.join(old, links.columns, "left_anti"))

    def extract_entities(self) -> None:
        types = self.model.active_entities

        def keep(jobs: DataFrame) -> None:
            self._merge("entity", materialize.entities_of(self._stored(materialize.typed_items(jobs, "entities", "_entity_type"), "entity_items"), types), types)

        self._none("entity", "entities")
        self._work_off("EXTRACT_ENTITIES", self.entity_units, self.entity_requests, keep)

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        """Decoded items, written once for the types that are taken from them."""
        return self._write(f"decoded/{name}", rows)

    def _none(self, kind: str, objects: str) -> None:
        """Empty datasets where there are none yet."""
        ends = "source_id string, target_id string, " if kind == "relationship" else ""
        for name, schema in ((objects, f"{kind}_id string, {kind}_type_name string, {ends}n_mentions long, properties map<string,string>"), (f"{kind}_provenance", f"context_level string, context_id string, {kind}_id string")):
            if self.workspace.read(self.spark, name) is None:
                self._write(name, self.spark.createDataFrame([], schema))

    def _entities_here(self) -> DataFrame:
        """Entities of each chunk at both levels, with their names; chunks without one of their own are left out."""
        entities, links = self.workspace.read(self.spark, "entities"), self.workspace.read(self.spark, "entity_provenance")
        chunks = self.workspace.read(self.spark, "chunks").select("chunk_id", F.col("content_id").alias("document"))
        own = links.where("context_level = 'CHUNK'").join(chunks, F.col("context_id") == F.col("chunk_id")).select("chunk_id", "document", "context_level", "entity_id")
        above = links.where("context_level = 'DOCUMENT'").select(F.col("context_id").alias("document"), "context_level", "entity_id").join(own.select("chunk_id", "document").distinct(), "document").select("chunk_id", "document", "context_level", "entity_id")
        pk = F.create_map(*[F.lit(x) for t in self.model.active_entities for x in (t.name, t.primary_key)])
        named = entities.select("entity_id", "entity_type_name", F.try_element_at("properties", F.try_element_at(pk, F.col("entity_type_name"))).alias("name"))
        return own.unionByName(above).join(named, "entity_id")

    def relationship_units(self) -> DataFrame:
        viable = planning.viable(self._entities_here(), self._endpoints())
        units = viable.select(F.lit("CHUNK").alias("context_level"), F.col("chunk_id").alias("context_id"), "relationship_type_name")
        return lifecycle.planned(units, self.workspace.read(self.spark, "relationship_units"), self.KEYS["EXTRACT_RELATIONSHIPS"])

    def _candidates(self, units: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The units' requests without their texts, and what the temporary ids of each job stand for."""
        viable = units.select(F.col("context_id").alias("chunk_id"), "relationship_type_name")
        types = units.groupBy("context_level", "context_id").agg(F.sort_array(F.collect_set("relationship_type_name")).alias("types"))
        asked = self._numbered(types, units, "relationships")
        wanted = planning.candidates(self._entities_here(), viable, self._endpoints()).join(asked.select("job_id", F.col("context_id").alias("chunk_id")), "chunk_id")
        temp = relationships.temporary_ids(wanted)
        return asked, wanted.select("job_id", "entity_id", "entity_type_name", "context_level", "name").distinct().join(temp, ["job_id", "entity_id"])

    def relationship_requests(self, units: DataFrame) -> DataFrame:
        asked, references = self._candidates(units)
        listed = references.groupBy("job_id").agg(F.array_sort(F.collect_set(F.struct("temp_id", "entity_type_name", "name"))).alias("candidates"))
        texts = self.workspace.read(self.spark, "chunks").select(F.col("chunk_id").alias("context_id"), F.col("content").alias("text"))
        return prompts(asked.join(listed, "job_id").join(texts, "context_id").select("job_id", "task", "context_level", "context_id", "types", "candidates", "text"), relationship_prompt(self.model))

    def extract_relationships(self) -> None:
        self._none("relationship", "relationships")
        types = self.model.active_relationships
        if not types:
            return

        def keep(jobs: DataFrame) -> None:
            references = self._candidates(self.workspace.read(self.spark, "relationship_units").where("status = 'IN_PROGRESS'"))[1]
            rows = self._stored(materialize.relationship_items(jobs), "relationship_items")
            self._merge("relationship", materialize.relationships_of(rows, references, self.model, self._endpoints()), types, ("source_id", "target_id"))

        self._work_off("EXTRACT_RELATIONSHIPS", self.relationship_units, self.relationship_requests, keep)

    def export(self) -> None:
        """The graph as CSV with an import script, or as lines, put in place as a whole."""
        target = self.workspace.at(self.settings["export"]["path"])
        folder, _, name = target.rpartition("/")
        new = f"{folder}/.{name}-new"
        storage.delete(new)
        storage.write_text(f"{new}/.written", "")
        entities, links = self.workspace.read(self.spark, "entities"), self.workspace.read(self.spark, "relationships")
        sources = self.workspace.read(self.spark, "entity_provenance")
        nodes, edges = {}, {}
        for t in self.model.active_entities:
            fields = {f.name: f.data_type for f in t.fields}
            own = entities.where(F.col("entity_type_name") == t.name).select("entity_id", *[F.try_element_at("properties", F.lit(f.name)).cast(materialize.SPARK_TYPE[f.data_type]).alias(f.name) for f in t.fields])
            path = f"nodes-{t.name}"
            if self.settings["export"]["format"] == "csv":
                graph.write_csv(graph.csv_rows(own, "entity_id", fields), storage.uri(f"{new}/{path}"))
            else:
                graph.write_lines(graph.graph_lines(own, t.name, "entity_id", fields), storage.uri(f"{new}/{path}"))
            nodes[t.name] = path
        for name, rows, a, b in [*((r.name, links.where(F.col("relationship_type_name") == r.name), "source_id", "target_id") for r in self.model.active_relationships), ("ExtractedFrom", sources, "entity_id", "context_id")]:
            path = f"edges-{name}"
            if self.settings["export"]["format"] == "csv":
                graph.write_csv(graph.csv_edges(rows, a, b, {}), storage.uri(f"{new}/{path}"))
            else:
                graph.write_lines(graph.edge_lines(rows, name, a, b), storage.uri(f"{new}/{path}"))
            edges[name] = path
        if self.settings["export"]["format"] == "csv":
            storage.write_text(f"{new}/import.sh", graph.import_script(nodes, edges))
        graph.write_stats(self.stats(), f"{new}/stats.json")
        graph.replace_directory(new, target)

    STEPS = {"INGEST_DOCUMENTS": ingest, "EXTRACT_ENTITIES": extract_entities, "EXTRACT_RELATIONSHIPS": extract_relationships, "EXPORT_KNOWLEDGE": export}

    def run(self, add_documents: bool = False) -> list[str]:
        """Runs the steps that aren't done; with add_documents all of them, for what has come in since. Returns the steps that are done now.

        A step some of whose units wait for another try ends the run; the next one goes on with them.
        """
        self.check()
        state = self.workspace.state()
        if add_documents:
            state["done"] = []
        state["inputs"] = self.inputs
        self.workspace.save(state)
        ran = []
        while step := lifecycle.next_step(set(state["done"])):
            began, waits = time.time(), False
            try:
                self.STEPS[step](self)
                ran.append(step)
            except Unfinished:
                waits = True
            state = self.workspace.state()
            state["done"] += [] if waits else [step]
            state["runs"].append({"step": step, "finished_at": int(time.time() * 1000), "duration_ms": int((time.time() - began) * 1000)})
            self.workspace.save(state)
            if waits:
                break
        return ran

    def done(self) -> bool:
        return lifecycle.next_step(set(self.workspace.state()["done"])) is None

    def plan(self) -> dict:
        """What would be asked for, without asking: requests by step, as far as the steps before are done."""
        out = {"next": lifecycle.next_step(set(self.workspace.state()["done"]))}
        contexts = lambda units: units.where("status IN ('PENDING', 'IN_PROGRESS', 'RETRY')").select("context_level", "context_id").distinct().count()
        if self.workspace.read(self.spark, "chunks") is not None:
            out["entity_requests"] = contexts(self.entity_units())
        if self.workspace.read(self.spark, "entities") is not None:
            out["relationship_requests"] = contexts(self.relationship_units())
        return out

    def stats(self) -> dict:
        """Counts of a row each, and tokens by task."""
        out: dict = {}
        for name in ("documents", "chunks", "entity_mentions", "entities", "relationships"):
            rows = self.workspace.read(self.spark, name)
            if rows is not None:
                out[name] = rows.count()
        for task in ("entity_jobs", "relationship_jobs"):
            rows = self.workspace.read(self.spark, task)
            if rows is not None:
                sums = [F.coalesce(F.sum(f"{t}_tokens"), F.lit(0)).alias(t) for t in ("input", "cached", "cache_write", "output", "reasoning")]
                out[task] = rows.agg(F.count("*").alias("jobs"), F.count_if(F.col("content").isNull()).alias("without_response"), *sums).first().asDict()
        return out
