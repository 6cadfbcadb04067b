import pytest
from pyspark.sql import functions as F

from kgforge.model.loader import model_of
from kgforge.model.ontology import compile_ontology
from kgforge.workflow import remote


def test_calls_and_their_failures(spark):
    def make():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "flaky" and seen[prompt] < 2 or prompt == "down":
                raise ConnectionError
            if prompt == "late":
                raise TimeoutError
            if prompt == "bad":
                raise type("Refused", (Exception,), {"status": 403})
            if prompt == "bug":
                raise KeyError
            return {"content": prompt.upper(), "input_tokens": 3}

        return call

    rows = spark.createDataFrame([(p, p) for p in ("ok", "flaky", "down", "late", "bad", "bug")], "job_id string, prompt string")
    got = {r["job_id"]: (r["content"], r["error_class"]) for r in remote.Remote(make, tasks=1, at_once=2, tries=2, pause=0)(rows).collect()}
    assert got == {"ok": ("OK", None), "flaky": ("FLAKY", None), "down": (None, "transient"), "late": (None, "timeout"), "bad": (None, "config"), "bug": (None, "internal")}


def test_batch_files(spark, tmp_path):
    path = f"file://{tmp_path}/requests"
    remote.write_batch(spark.createDataFrame([("1", "p")], "job_id string, prompt string"), path)
    assert spark.read.text(path).first()["value"] == '{"job_id":"1","body":{"prompt":"p"}}'
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "a.jsonl").write_text('{"job_id":"1","status":200,"body":{"content":"c","usage":{"input":"9","cached":"4","output":"x"}}}\nnot json\n{"job_id":"2","status":503}\n{"job_id":"3","status":200,"body":{"refused":true,"usage":{"input":"2"}}}\n')
    got = {r["job_id"]: (r["content"], r["error_class"], r["input_tokens"], r["output_tokens"]) for r in remote.read_batch(spark, f"file://{tmp_path}/results").collect()}
    assert got == {"1": ("c", None, 5, None), "2": (None, "transient", None, None), "3": (None, "response", 2, None)}


def test_status_classes(spark):
    rows = spark.createDataFrame([(s,) for s in (200, 400, 408, 429, 500, 302, None)], "s int").select(remote.status_class(F.col("s")).alias("c"))
    assert [r["c"] for r in rows.collect()] == [None, "config", "transient", "transient", "transient", "internal", "internal"]


def test_until_done():
    said, waits = iter([False, OSError, OSError, True]), []

    def run():
        x = next(said)
        if x is OSError:
            raise OSError
        return x

    assert remote.until_done(run, sleep=waits.append) == 4 and len(waits) == 3
    with pytest.raises(OSError):
        remote.until_done(lambda: (_ for _ in ()).throw(OSError()), sleep=lambda s: None)


def test_ontology():
    ontology = {"title": "culture", "concepts": [{"qid": "Q1", "label": "film"}, {"qid": "Q2", "label": "2nd unit"}], "relations": [{"label": "made by", "domain": "Q1", "range": "Q2"}, {"label": "release date", "domain": "Q1", "range": ""}]}
    m = model_of(compile_ontology(ontology))
    assert {t.name for t in m.entity_types} == {"Film", "X2ndUnit", "Value"} and {r.name for r in m.relationship_types} == {"MadeBy", "ReleaseDate"}
    fields = model_of(compile_ontology(ontology, literals_as_fields=True))
    assert {f.name for f in fields.entity("Film").fields} == {"name", "release_date"} and len(fields.relationship_types) == 1
