import copy
import json

import pytest
from pyspark.sql import functions as F

from kgforge.cli import main
from kgforge.model.loader import load_settings, model_of, read_json
from kgforge.model.schema import ModelError
from kgforge.operators import materialize
from kgforge.workflow.engine import Engine, Workspace
from kgforge.workflow.extractors import Rules, field_line, response_schema

MODEL = {
    "extraction_config": {"llm": {"domain": "shipping", "language": "en"}},
    "entity_types": {
        "Vessel": {
            "description": "A ship", "primary_key": "name", "document_collections": {"chunk": ["logs"], "document": "logs"},
            "fields": {
                "name": {"data_type": "string", "description": "", "required": True}, "kind": {"data_type": "str", "options": ["Tanker", "Ferry"], "default_value": "Ferry"}, "built": {"data_type": "date", "min": "1800", "merge_strategy": "keep"},
                "crew": {"data_type": "int", "min": 0, "max": 500, "merge_strategy": "largest"}, "fleet": {"data_type": "text", "default_value": "north", "retrieval_mode": "default"},
            },
        },
        "Port": {"description": "A port", "primary_key": "name", "document_collections": {"chunk": "logs"}, "fields": {"name": {"data_type": "string", "required": True}}},
    },
    "relationship_types": {
        "Visited": {"description": "called at", "endpoints": {"Vessel": {"Port": {"source_context_levels": ["chunk", "document"], "target_context_levels": "chunk"}}}, "deduplication": "endpoints"},
        "SisterOf": {"description": "", "endpoints": {"Vessel": {"Vessel": {"source_context_levels": "chunk", "target_context_levels": "chunk"}}}, "deduplication": "endpoints", "symmetric": True},
    },
}
TEXTS = {
    "a.txt": "The vessel Aurora (tanker, built 1970, crew 20) left. Aurora called at Port Kiel. Aurora and Boreas are sisters.\nThe vessel Boreas (crew 900) waits.",
    "b.txt": "The vessel AURORA (built 1970-05, crew 35) came. Boreas and Aurora are sisters. The vessel Boreas (crew 7) left.",
}
RULES = Rules(
    {"Vessel": r"vessel (?P<name>\w+) \((?:(?P<kind>tanker|ferry), )?(?:built (?P<built>[\d-]+), )?crew (?P<crew>\d+)\)", "Port": r"Port (?P<name>\w+)"},
    {"Visited": ("Vessel", "Port", r"(?P<source>\w+) called at Port (?P<target>\w+)"), "SisterOf": ("Vessel", "Vessel", r"(?P<source>\w+) and (?P<target>\w+) are sisters")},
)


@pytest.fixture
def engine(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    for name, text in TEXTS.items():
        (data / name).write_text(text)
    work = Workspace(str(tmp_path / "work"))
    assert len(work.init()) == 2 and work.init() == []
    (work.path / "knowledge_model.json").write_text(json.dumps(MODEL))
    (work.path / "document_collections.json").write_text(json.dumps({"collections": {"logs": {"sources": [{"root": ".", "mode": "directory"}]}}}))
    return Engine(spark, work, f"file://{data}", RULES)


def test_documents_to_graph(engine, spark, tmp_path):
    assert engine.run() == ["INGEST_DOCUMENTS", "EXTRACT_ENTITIES", "EXTRACT_RELATIONSHIPS", "EXPORT_KNOWLEDGE"] and engine.run() == []
    entities = {(r["entity_type_name"], r["properties"]["name"].lower()): r["properties"] for r in engine.workspace.read(spark, "entities").collect()}
    aurora, boreas = entities["Vessel", "aurora"], entities["Vessel", "boreas"]
    assert set(entities) == {("Vessel", "aurora"), ("Vessel", "boreas"), ("Port", "kiel")}
    assert aurora["crew"] == "35" and aurora["built"] == "1970-05" and aurora["fleet"] == "north" and boreas["crew"] == "7" and "built" not in boreas
    links = engine.workspace.read(spark, "relationships").collect()
    assert sorted((r["relationship_type_name"], r["n_mentions"]) for r in links) == [("SisterOf", 2), ("Visited", 1)]
    stats = json.loads((engine.workspace.path / "export" / "stats.json").read_text())
    assert stats["documents"] == 2 and stats["entities"] == 3 and stats["relationship_jobs"]["without_response"] == 0
    assert (engine.workspace.path / "export" / "import.sh").read_text().count("--nodes=") == 2
    # more documents: only what is new is added, and the graph grows
    (tmp_path / "data" / "c.txt").write_text("The vessel Corona (crew 3) left.")
    assert len(engine.run(add_documents=True)) == 4 and engine.workspace.read(spark, "entities").count() == 4
    assert engine.plan() == {"next": None, "entity_requests": 0, "relationship_requests": 0}
    assert engine.workspace.reset("EXTRACT_RELATIONSHIPS") == ["EXTRACT_RELATIONSHIPS", "EXPORT_KNOWLEDGE"] and engine.workspace.read(spark, "relationships") is None


class Asked:
    """An extractor that notes what it is asked, and fails as told: by task and a word of the text, how often and how."""

    def __init__(self, inner, fails=()):
        self.inner, self.asked, self.fails = inner, [], dict(fails)

    def __call__(self, requests):
        rows = requests.select("job_id", "task", "context_level", "types", "text").collect()
        self.asked += [(r["task"], r["context_level"], r["text"].split()[2] if len(r["text"].split()) > 2 else "") for r in rows]
        wrong = {}
        for r in rows:
            for (task, word), (times, kind) in self.fails.items():
                if r["task"] == task and word in r["text"] and times:
                    self.fails[task, word] = (times - 1, kind)
                    wrong[r["job_id"]] = kind
        out = self.inner(requests)
        spark = requests.sparkSession
        failed = spark.createDataFrame(list(wrong.items()), "job_id string, error_class string")
        out = out.drop("error_class").join(failed, "job_id", "left")
        broken = F.col("error_class") == "response"
        return out.withColumns({"content": F.when(broken, "no JSON").when(F.col("error_class").isNull(), F.col("content")), "error_class": F.when(~broken, F.col("error_class"))}).select("job_id", "content", "error_class", *[f"{t}_tokens" for t in ("input", "cached", "cache_write", "output", "reasoning")])


def statuses(engine, spark, name="entity_units"):
    return {(r["context_level"], r["entity_type_name"], r["status"], r["attempts"], r["failed"], r["last_error"]) for r in engine.workspace.read(spark, name).collect()}


def test_a_new_file_makes_requests_for_that_file_alone(engine, spark, tmp_path):
    first = Asked(RULES)
    engine.extractor = first
    engine.run()
    assert len([a for a in first.asked if a[0] == "entities"]) == 4
    chunks = engine.workspace.read(spark, "chunks").count()
    before = {r["entity_id"]: r["n_mentions"] for r in engine.workspace.read(spark, "entities").collect()}
    (tmp_path / "data" / "c.txt").write_text("The vessel Corona (crew 3) left. The vessel Aurora (crew 400) waits.")
    engine.extractor = again = Asked(RULES)
    engine.run(add_documents=True)
    assert sorted(again.asked) == [("entities", "CHUNK", "Corona"), ("entities", "DOCUMENT", "Corona"), ("relationships", "CHUNK", "Corona")]
    assert engine.workspace.read(spark, "chunks").count() == chunks + 1
    entities = {r["entity_id"]: r for r in engine.workspace.read(spark, "entities").collect()}
    aurora = next(r for r in entities.values() if r["properties"]["name"].lower() == "aurora")
    # merged into what was stored: the largest crew, and what only the stored one has
    assert aurora["properties"]["crew"] == "400" and aurora["properties"]["built"] == "1970-05" and aurora["n_mentions"] == before[aurora["entity_id"]] + 2
    engine.extractor = idle = Asked(RULES)
    assert len(engine.run(add_documents=True)) == 4 and idle.asked == []
    assert {r["entity_id"]: r["n_mentions"] for r in engine.workspace.read(spark, "entities").collect()} == {k: r["n_mentions"] for k, r in entities.items()}


def test_failures_are_tried_again_by_their_class(engine, spark):
    # an answer that can't be read is asked for again in the same run; one that came too late in the next; a refused one never
    engine.extractor = Asked(RULES, {("entities", "Corona"): (0, ""), ("entities", "Boreas (crew 900)"): (1, "response"), ("entities", "AURORA"): (1, "transient")})
    assert engine.run() == ["INGEST_DOCUMENTS"]
    found = statuses(engine, spark)
    assert {x[2] for x in found} == {"COMPLETED", "RETRY"} and any(x[2:4] == ("COMPLETED", 2) and x[4] == 1 for x in found) and any(x[2] == "RETRY" and x[3] == 0 and x[5] == "transient" for x in found)
    assert engine.workspace.status(spark)["steps"]["EXTRACT_ENTITIES"]["resolved"] < 6 and engine.plan()["entity_requests"] == 1
    assert engine.run() == ["EXTRACT_ENTITIES", "EXTRACT_RELATIONSHIPS", "EXPORT_KNOWLEDGE"] and engine.done()
    assert {x[2] for x in statuses(engine, spark)} == {"COMPLETED"}
    engine.workspace.reset("EXTRACT_ENTITIES")
    engine.extractor = Asked(RULES, {("entities", "AURORA"): (99, "config"), ("entities", "Boreas (crew 900)"): (99, "response")})
    assert engine.run()[-1] == "EXPORT_KNOWLEDGE"
    assert {(x[2], x[3], x[4], x[5]) for x in statuses(engine, spark) if x[2] == "FAILED"} == {("FAILED", 1, 0, "config"), ("FAILED", 3, 3, "response")}


def test_a_run_that_breaks_off_goes_on(engine, spark):
    class Breaks(Asked):
        def __call__(self, requests):
            if requests.limit(1).collect()[0]["task"] == "relationships":
                raise OSError("gone")
            return super().__call__(requests)

    engine.extractor = first = Breaks(RULES)
    with pytest.raises(OSError, match="gone"):
        engine.run()
    assert {r["status"] for r in engine.workspace.read(spark, "relationship_units").collect()} == {"IN_PROGRESS"}
    asked = len(first.asked)
    engine.extractor = second = Asked(RULES)
    assert engine.run() == ["EXTRACT_RELATIONSHIPS", "EXPORT_KNOWLEDGE"] and asked == 4 and {a[0] for a in second.asked} == {"relationships"}
    assert {(r["status"], r["attempts"]) for r in engine.workspace.read(spark, "relationship_units").collect()} == {("COMPLETED", 1)}


def test_claims_of_some_contexts_at_a_time_give_the_same(engine, spark):
    engine.run()
    whole = {r["entity_id"]: (r["n_mentions"], tuple(sorted(r["properties"].items()))) for r in engine.workspace.read(spark, "entities").collect()}
    engine.workspace.reset("EXTRACT_ENTITIES")
    engine.settings["pipeline"]["claim"] = 1
    engine.extractor = Asked(RULES)
    engine.run()
    assert {k: n for k, (n, _) in whole.items()} == {r["entity_id"]: r["n_mentions"] for r in engine.workspace.read(spark, "entities").collect()}
    assert engine.workspace.read(spark, "entity_jobs").agg(F.max("claimed")).first()[0] == 3


def test_a_long_document(engine, spark, tmp_path):
    (tmp_path / "data" / "long.txt").write_text("The vessel Dorado (crew 5) left. " + "word " * 50_000 + "The vessel Elara (crew 6) left.")
    engine.run()
    heads = engine.contexts().where("context_level = 'DOCUMENT'").select(F.size(F.split("text", r"\s+")).alias("n")).collect()
    assert max(r["n"] for r in heads) == 8000
    names = {r["properties"]["name"] for r in engine.workspace.read(spark, "entities").where("entity_type_name = 'Vessel'").collect()}
    assert {"Dorado", "Elara"} <= names  # the chunks go to the end


def test_changed_model_needs_a_reset(engine, spark):
    engine.run()
    changed = copy.deepcopy(MODEL)
    changed["entity_types"]["Port"]["description"] = "other"
    (engine.workspace.path / "knowledge_model.json").write_text(json.dumps(changed))
    with pytest.raises(ValueError, match="reset"):
        Engine(spark, engine.workspace, engine.data, RULES).run()


@pytest.mark.parametrize(("path", "value", "said"), [
    (("entity_types", "Vessel", "primary_key"), "none", "no field none"), (("entity_types", "Vessel", "fields", "crew", "min"), 900, "above"), (("entity_types", "Vessel", "fields", "kind", "default_value"), "Raft", "not allowed"),
    (("entity_types", "Vessel", "fields", "built", "regex"), "x", "pattern"), (("entity_types", "Vessel", "fields", "crew", "merge_strategy"), "longest", "no strategy"), (("entity_types", "Vessel", "fields", "crew", "retrieval_mode"), "load", "no retrieval mode"),
    (("entity_types", "Vessel", "fields", "name", "required"), False, "required"), (("relationship_types", "Visited", "deduplication"), "primary_key", "no field None"), (("relationship_types", "Visited", "endpoints", "Crew"), {}, ""),
    (("relationship_types", "SisterOf", "endpoints", "Vessel", "Vessel", "source_context_levels"), "page", "no pair of levels"), (("relationship_types", "Visited", "allow_self_relationships"), True, "with itself"), (("entity_types", "Vessel", "colour"), 1, "unknown colour"),
    (("extraction_config", "projection"), {"enabled_entities": ["Raft"]}, "no entity type Raft"), (("entity_types", "Vessel", "fields", "built", "min"), "1800-13", ""),
])
def test_wrong_models(path, value, said):
    model = copy.deepcopy(MODEL)
    at = model
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    if said:
        with pytest.raises(ModelError, match=said):
            model_of(model)
    else:
        model_of(model)


def test_projection_and_files(tmp_path):
    model = copy.deepcopy(MODEL)
    model["extraction_config"]["projection"] = {"enabled_entities": ["Vessel"]}
    m = model_of(model)
    assert [t.name for t in m.active_entities] == ["Vessel"] and [r.name for r in m.active_relationships] == ["SisterOf"] and m.warnings() == []
    (tmp_path / "m.json").write_bytes(b'\xef\xbb\xbf{"a": 1, "a": 2}')
    with pytest.raises(ModelError, match="twice"):
        read_json(tmp_path / "m.json")
    (tmp_path / "s.toml").write_text("[chunking]\ntarget = 5\n")
    assert load_settings(tmp_path / "s.toml")["chunking"]["target"] == 5 and load_settings(None)["chunking"]["target"] == 800
    (tmp_path / "t.toml").write_text("[chunks]\n")
    with pytest.raises(ModelError, match="unknown chunks"):
        load_settings(tmp_path / "t.toml")
    schema = response_schema(m.active_entities, "_entity_type", "entities")
    assert schema["properties"]["entities"]["items"]["anyOf"][0]["properties"]["kind"]["enum"] == ["Tanker", "Ferry", None]


def test_responses_of_all_kinds(spark):
    m = model_of(MODEL)
    said = [
        'Sure! {"entities": [{"_entity_type": "vessel", "name": ["Aurora"], "crew": "1.200"}]}', '[{"_entity_type": "Vessel", "name": "B", "crew": 3.0, "kind": "FERRY"}, 7, {"_entity_type": "Vessel"}]', "prose", '{"entities": {"a": 1}}', None,
        '{"entities": [{"_entity_type": "Raft", "name": "x"}, {"_entity_type": "Vessel", "name": "null"}, {"_entity_type": "Vessel", "name": "///"}]}',
    ]
    rows = spark.createDataFrame([(str(k), "CHUNK", f"c{k}", ["Vessel"], s) for k, s in enumerate(said)], "job_id string, context_level string, context_id string, types array<string>, content string")
    got = {r["job_id"] + r["properties"]["name"]: r["properties"] for r in materialize.entity_mentions(rows, m.active_entities).collect()}
    assert got == {"0Aurora": {"name": "Aurora", "fleet": "north", "kind": "Ferry"}, "1B": {"name": "B", "crew": "3", "fleet": "north", "kind": "Ferry"}}


def test_command_line(tmp_path, capsys):
    work = str(tmp_path / "w")
    assert main(["init", work]) == 0 and main(["reset", work]) == 1 and main(["reset", work, "--yes"]) == 0 and main(["status", work]) == 0
    assert '"next": "INGEST_DOCUMENTS"' in capsys.readouterr().out
    assert main(["run", str(tmp_path / "none"), str(tmp_path)]) == 1


def test_all_names_of_strategies_and_settings_by_level():
    names = {"string": "keep existing preserve retain first replace incoming overwrite update last longest verbose complete shortest concise minimal", "integer": "largest max maximum smallest min minimum", "float": "Max min", "boolean": "any or all and", "date": "latest earliest"}
    for kind, said in names.items():
        for name in said.split():
            fields = {"name": {"data_type": "string", "required": True}, "x": {"data_type": kind, "merge_strategy": name}}
            model_of({"entity_types": {"Thing": {"primary_key": "name", "fields": fields}}})
    by_level = {"data_type": "int", "min": {"chunk": 1, "document": 10}, "max": {"DOCUMENT": 20}, "default_value": {"document": 12}, "retrieval_mode": {"document": "default"}, "instructions": {"chunk": "Count."}}
    model = {"entity_types": {"Thing": {"primary_key": "name", "fields": {"name": {"data_type": "string", "required": True}, "x": by_level, "s": {"data_type": "string", "regex": {"chunk": "a+", "document": "b+"}}}}}}
    x = model_of(model).entity("Thing").fields[1]
    assert (x.least, x.most, x.default, x.mode("CHUNK"), x.mode("DOCUMENT")) == ({"CHUNK": 1, "DOCUMENT": 10}, {"DOCUMENT": 20}, {"DOCUMENT": 12}, "EXTRACT", "DEFAULT") and not x.alike_at_all_levels()
    assert x.allows(3, "CHUNK") and not x.allows(3, "DOCUMENT") and field_line(x).endswith("(chunk) Count.")
    for wrong, said in (({"min": {"page": 1}}, "no level PAGE"), ({"min": {"chunk": 30}, "max": {"chunk": 20}}, "above"), ({"default_value": {"document": 3}, "min": {"document": 10}}, "not allowed"), ({"min": {"chunk": 1, "CHUNK": 2}}, "twice")):
        bad = copy.deepcopy(model)
        bad["entity_types"]["Thing"]["fields"]["x"] = {"data_type": "int", **wrong}
        with pytest.raises(ModelError, match=said):
            model_of(bad)


def test_values_by_level(spark):
    fields = {"name": {"data_type": "string", "required": True}, "x": {"data_type": "int", "min": {"chunk": 1, "document": 10}, "default_value": {"document": 12}}, "s": {"data_type": "string", "regex": {"chunk": "a+"}}}
    types = model_of({"entity_types": {"Thing": {"primary_key": "name", "fields": fields}}}).active_entities
    said = json.dumps([{"_entity_type": "Thing", "name": "n", "x": 5, "s": "bb"}])
    rows = spark.createDataFrame([(level, level, level, ["Thing"], said) for level in ("CHUNK", "DOCUMENT")], "job_id string, context_level string, context_id string, types array<string>, content string")
    got = {r["job_id"]: r["properties"] for r in materialize.entity_mentions(rows, types).collect()}
    assert got == {"CHUNK": {"name": "n", "x": "5"}, "DOCUMENT": {"name": "n", "s": "bb", "x": "12"}}


def rules_for(spark):
    return RULES


def test_command_line_runs_until_done(spark, tmp_path, capsys, monkeypatch):
    import kgforge.cli

    monkeypatch.setattr(kgforge.cli, "session", lambda: spark)
    data, work = tmp_path / "data", str(tmp_path / "work")
    data.mkdir()
    (data / "a.txt").write_text(TEXTS["a.txt"])
    assert main(["init", work]) == 0
    (tmp_path / "work" / "knowledge_model.json").write_text(json.dumps(MODEL))
    (tmp_path / "work" / "document_collections.json").write_text(json.dumps({"collections": {"logs": {"sources": [{"root": ".", "mode": "directory"}]}}}))
    assert main(["plan", work, f"file://{data}", "--extractor", "test_workflow:rules_for"]) == 0
    assert main(["run", work, f"file://{data}", "--extractor", "test_workflow:rules_for", "--until-done", "--wait", "0"]) == 0
    assert main(["status", work]) == 0
    said = capsys.readouterr().out
    assert "EXPORT_KNOWLEDGE" in said and '"resolved": 3' in said and '"next": null' in said
