import json

import pytest
from pyspark.sql import functions as F

from kgforge.operators import chunking, lifecycle
from kgforge.workflow import limits
from kgforge.workflow.engine import Engine, Workspace
from kgforge.workflow.extractors import RESPONSE

from test_workflow import MODEL, RULES, TEXTS

PARTS = ("input", "cached", "cache_write", "output", "reasoning")


class Office:
    """Answers batches by the rules when told to, leaving out what is said."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.held, self.cancelled, self.gone = spark, folder, {}, [], False

    def submit(self, path):
        self.held[path] = "IN_PROGRESS"
        return path

    def status(self, name):
        if self.gone:
            raise OSError("no line")
        return self.held[name]

    def cancel(self, name):
        self.cancelled.append(name)

    def results(self, name):
        return f"{name}-results" if self.held[name] == "COMPLETED" else None

    def answer(self, engine, without=()):
        """Works off all that is open; the requests' rows come from the engine's own note of its jobs."""
        for name in [n for n, s in self.held.items() if s == "IN_PROGRESS"]:
            jobs = {json.loads(r["value"])["job_id"]: json.loads(r["value"])["body"]["prompt"] for r in self.spark.read.text(f"file://{name}").collect()}
            noted = [engine.workspace.read(self.spark, f"{kind}_units_batched") for kind in ("entity", "relationship")]
            rows = [r.asDict() | {"text": jobs[r["job_id"]].rpartition("Text:\n")[2]} for d in noted if d is not None for r in d.select("job_id", "task", "types", "candidates").collect() if r["job_id"] in jobs]
            asked = self.spark.createDataFrame([(r["job_id"], r["task"], r["types"], [tuple(c) for c in r["candidates"]], r["text"]) for r in rows], "job_id string, task string, types array<string>, candidates array<struct<temp_id:string,entity_type_name:string,name:string>>, text string")
            said = [r for r in RULES(asked).collect() if not any(w in next(x["text"] for x in rows if x["job_id"] == r["job_id"]) for w in without)]
            lines = [json.dumps({"job_id": r["job_id"], "status": 200, "body": {"content": r["content"], "usage": {"input": "7", "output": "2"}}}) for r in said]
            self.spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"file://{name}-results")
            self.held[name] = "COMPLETED"


@pytest.fixture
def engine(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for name, text in TEXTS.items():
        (data / name).write_text(text)
    work = Workspace(str(tmp_path / "work"))
    work.init()
    (work.path / "knowledge_model.json").write_text(json.dumps(MODEL))
    (work.path / "document_collections.json").write_text(json.dumps({"collections": {"logs": {"sources": [{"root": ".", "mode": "directory"}]}}}))
    clock = [1e6]
    out = Engine(spark, work, f"file://{data}", None, service=Office(spark, tmp_path), now=lambda: clock[0])
    out.clock = clock
    return out


def by_status(engine, spark):
    return {r["status"]: r["n_units"] for r in lifecycle.progress(engine.workspace.read(spark, "entity_units")).collect()}


def test_batches_are_collected_by_later_runs(engine, spark):
    assert engine.run() == ["INGEST_DOCUMENTS"] and by_status(engine, spark) == {"IN_PROGRESS": 6}
    assert engine.run() == [] and len(engine.service.held) == 1 and by_status(engine, spark) == {"IN_PROGRESS": 6}
    engine.service.gone = True
    assert engine.run() == [] and by_status(engine, spark) == {"IN_PROGRESS": 6}
    engine.service.gone = False
    # one context's answers are missing, so it goes out again in a batch of its own
    engine.service.answer(engine, without=["AURORA"])
    assert engine.run() == [] and len(engine.service.held) == 2 and by_status(engine, spark)["COMPLETED"] == 3
    engine.service.answer(engine)
    assert engine.run() == ["EXTRACT_ENTITIES"] and len(engine.service.held) == 3
    engine.service.answer(engine)
    assert engine.run() == ["EXTRACT_RELATIONSHIPS", "EXPORT_KNOWLEDGE"] and engine.done()
    assert {r["properties"]["name"].lower() for r in engine.workspace.read(spark, "entities").collect()} == {"aurora", "boreas", "kiel"}
    assert sorted((r["relationship_type_name"], r["n_mentions"]) for r in engine.workspace.read(spark, "relationships").collect()) == [("SisterOf", 2), ("Visited", 1)]
    assert engine.stats()["entity_jobs"]["input"] > 0


def test_overdue_batches_are_cancelled_and_then_given_up(engine, spark):
    engine.run()
    first = next(iter(engine.service.held))
    engine.clock[0] += 25.5 * 3600
    assert engine.run() == [] and engine.service.cancelled == [first] and len(engine.service.held) == 1
    engine.clock[0] += 3600
    assert engine.run() == [] and len(engine.service.held) == 2 and by_status(engine, spark) == {"IN_PROGRESS": 6}
    assert [b["status"] for b in engine.workspace.state()["batches"]] == ["CANCELLED", "SUBMITTED"]


def test_batch_actions():
    act = lifecycle.batch_action
    assert [act("IN_PROGRESS", h) for h in (1, 25, 26)] == ["wait", "cancel", "discard"] and act("FAILED", 99) == act("COMPLETED", 1) == "collect"
    assert act(None, 29 * 24) == "wait" and act(None, 30 * 24) == "discard"


def test_schemas_within_limits():
    field = lambda kind, **more: {"type": [kind, "null"], **more}
    some = {"type": "object", "properties": {"a": {"type": "string"}, "b": field("integer"), "c": field("string", enum=["x", None])}, "required": ["a", "b", "c"]}
    schema = {"type": "object", "properties": {"list": {"type": "array", "items": {"anyOf": [some]}}}, "required": ["list"]}
    found = limits.measure(schema)
    assert (found["properties"], found["unions"], found["optional"], found["depth"], found["enum_values"], found["letters"]) == (4, 3, 0, 2, 2, 8)
    assert limits.fitted(schema, limits.LARGE) == schema
    small = limits.fitted(schema, limits.SMALL)["properties"]["list"]["items"]["anyOf"][0]
    assert small["properties"]["c"] == {"enum": ["x", None]} and small["required"] == ["a", "b", "c"] and some["properties"]["c"]["type"] == ["string", "null"]
    many = {"type": "object", "properties": {f"f{k}": field("integer") for k in range(20)}, "required": [f"f{k}" for k in range(20)]}
    loose = limits.fitted(many, limits.SMALL)
    assert loose["required"] == [] and loose["properties"]["f0"] == {"type": "integer"}
    assert limits.fitted({"type": "object", "properties": {f"f{k}": field("integer") for k in range(30)}, "required": []}, limits.SMALL) is None
    long = {"enum": ["y" * 100 + str(k) for k in range(300)]}
    assert limits.fitted(long, limits.LARGE) is None and limits.fitted({"enum": long["enum"][:200]}, limits.LARGE)


def test_tokenizers_from_files(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"one": 0, "two": 1, "[UNK]": 2}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    own.save(str(tmp_path / "words.json"))
    plan = chunking.Plan(target=3, overlap=0, limit=4, tokenizer=str(tmp_path / "words.json"))
    text = "one two. three, four five six"
    chunks = chunking.Chunker(plan)(text)
    assert "".join(text[a:b] for a, b in chunks) == text and all(len(chunking.tokenizer_of(plan.tokenizer)(text[a:b])) <= 4 for a, b in chunks)
    assert chunking.first_tokens(text, 3, plan.tokenizer) == "one two."
    with pytest.raises(ValueError, match="no tokenizer"):
        chunking.Chunker(chunking.Plan(tokenizer="words"))


def test_response_columns_are_named(spark):
    assert {c.split()[0] for c in RESPONSE.split(", ")} == {"job_id", "content", "error_class", *(f"{p}_tokens" for p in PARTS)} and F is not None
