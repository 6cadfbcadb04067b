import csv
import json
from pathlib import Path

from pyspark.sql import functions as F

from kgforge.operators.documents import line_chunks
from kgforge.sinks import graph
from kgforge.streaming import ingest


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'say "x", y', 1e-05, "1969-07", None), ("b", "", 4.0, None, True)], "id string, name string, score double, day string, ok boolean")
    out = graph.csv_rows(rows, "id", {"name": "string", "score": "float", "day": "date", "ok": "boolean"})
    graph.write_csv(out.coalesce(1), f"file://{tmp_path}/n")
    part = next(Path(tmp_path, "n").glob("part-*"))
    got = list(csv.reader(part.open()))
    assert got == [["id:ID", "day:date", "name:string", "ok:boolean", "score:double"], ["a", "1969-07-01", 'say "x", y', "", "1e-05"], ["b", "", "", "true", "4.0"]]


def test_lines_script_stats_and_replace(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'q"\n', 3)], "id string, name string, n int")
    assert graph.graph_lines(rows, "L", "id", {"name": "string", "n": "integer"}).first()["value"] == 'N_a :L n:3 name:"q\\"\\n"'
    assert graph.import_script({"A": "a.csv"}, {"R": "r.csv"}).splitlines()[-1] == "  --relationships=R=r.csv"
    graph.write_stats({"b": {"c": 1}}, str(tmp_path / "stats.json"))
    assert json.loads((tmp_path / "stats.json").read_text()) == {"b": {"c": 1}}
    for name in ("new", "old"):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_text("")
    graph.replace_directory(str(tmp_path / "new"), str(tmp_path / "old"))
    assert [p.name for p in (tmp_path / "old").iterdir()] == ["new"] and not (tmp_path / "new").exists()


def test_versions(spark, tmp_path):
    v = graph.Versions(str(tmp_path / "set"))
    assert v.current() is None
    v.write(spark.range(3))
    v.write(spark.range(5))
    assert spark.read.parquet(v.current()).count() == 5


def test_triples(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    triples = spark.createDataFrame([("1", "a", "r", "b", 2), ("1", "c", "r", "d", 1), ("1", "a", "r", "b", 3)], "id string, sub string, rel string, obj string, position int")
    got = {json.loads(r["value"])["id"]: json.loads(r["value"])["triples"] for r in graph.triples_by_id(ids, triples).collect()}
    assert got == {"1": [["c", "r", "d"], ["a", "r", "b"]], "2": []}


def test_each_content_once_over_runs(spark, tmp_path):
    source, target, point = (f"file://{tmp_path}/{n}" for n in ("in", "out", "point"))
    for rows in ([("a",), ("b",), ("a",)], [("b",), ("c",)]):
        spark.createDataFrame(rows, "text string").write.mode("append").parquet(source)
        ingest.ingest(ingest.new_documents(spark, source, "text string"), target, point).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_links_and_chunks_by_batch(spark, tmp_path):
    source, target, links, point = (f"file://{tmp_path}/{n}" for n in ("in", "out", "links", "point"))
    for rows in ([("a\nb", "x")], [("a\nb", "y"), ("c", "y")]):
        spark.createDataFrame(rows, "text string, source string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("text string, source string").parquet(source)
        ingest.ingest_with_links(stream, "source", target, links, point, line_chunks).awaitTermination()
    assert spark.read.parquet(target).count() == 2 and spark.read.parquet(links).count() == 3 and spark.read.parquet(f"{target}-chunks").count() == 3


def test_windows_by_status(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:01:00", "DONE"), ("2024-01-01 00:02:00", "DONE"), ("2024-01-01 00:11:00", "FAILED")], "t string, status string").select(F.to_timestamp("t").alias("ts"), "status")
    got = {(r["window"]["start"].minute, r["status"]): r["n_units"] for r in ingest.status_counts(events).collect()}
    assert got == {(0, "DONE"): 2, (10, "FAILED"): 1}
