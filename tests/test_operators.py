import itertools
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgforge.functions.text import normalize_text
from kgforge.operators import chunking, documents, lifecycle, merge, ordering, planning, relationships
from kgforge.sources import files


@pytest.mark.parametrize(("kind", "strategy", "given_", "out"), [
    ("string", "keep", ["b", "a"], "b"), ("string", "replace", ["b", None, "a", None], "a"), ("string", "longest", ["bb", "aa", "c"], "aa"), ("string", "shortest", ["bb", "d", "c"], "c"),
    ("date", "keep", ["1823", None, "1825-11", "1823-02-28"], "1823-02-28"), ("date", "replace", ["1823-02", "1823", "1825"], "1825"), ("date", "largest", ["1823", "1825", "1825-11"], "1825-11"), ("date", "smallest", ["1825", "1823", "1823-01"], "1823-01"),
    ("string", "keep", [None, None], None),
])
def test_merges(spark, kind, strategy, given_, out):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(given_)], "g int, o int, v string")
    assert merge.merge(rows, ["g"], F.col("o"), {"v": (kind, strategy)}).first()["v"] == out


def test_order_free_strategies_are(spark):
    for strategy, out in (("longest", "bbb"), ("shortest", "a")):
        rows = [(n, k, v) for n, order in enumerate(itertools.permutations(["a", "bbb", "cc"])) for k, v in enumerate(order)]
        got = merge.merge(spark.createDataFrame(rows, "g int, o int, v string"), ["g"], F.col("o"), {"v": ("string", strategy)})
        assert {r["v"] for r in got.collect()} == {out}


def test_wrong_strategy():
    with pytest.raises(ValueError):
        merge.merged(None, None, "integer", "longest")


words = st.text(st.sampled_from("ab .!?\n#"), max_size=400)


@settings(max_examples=200, deadline=None)
@given(words, st.integers(3, 30), st.sampled_from(["whitespace", "character"]))
def test_chunks_tile_the_text(raw, target, tokenizer):
    plan = chunking.Plan(target=target, overlap=0, limit=int(1.3 * target), tokenizer=tokenizer)
    chunker = chunking.Chunker(plan)
    spans = chunker(raw)
    covered = "".join(raw[a:b] for a, b in spans)
    assert covered.replace(" ", "").replace("\n", "") == raw.replace(" ", "").replace("\n", "")
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(len(chunking.TOKENIZERS[tokenizer](raw[a:b])) <= plan.limit for a, b in spans)


def test_overlaps(spark):
    raw = " ".join(f"w{k}" for k in range(40))
    spans = chunking.Chunker(chunking.Plan(target=10, overlap=3, limit=12))(raw)
    for (_, end), (start, _) in zip(spans, spans[1:], strict=False):
        assert start < end and len(raw[start:end].split()) == 3
    rows = spark.createDataFrame([("d", raw), ("e", None), ("f", " \n ")], "content_id string, text string")
    out = chunking.chunks(rows, chunking.Plan(target=10, overlap=3, limit=12)).collect()
    assert [(r["start_offset"], r["end_offset"]) for r in out] == spans and {r["content_id"] for r in out} == {"d"}


def test_rebuild_with_overlap_and_gap(spark):
    rows = spark.createDataFrame([("d", 0, 4, "abcd"), ("d", 2, 6, "cdef"), ("d", 8, 9, "z")], "content_id string, start_offset int, end_offset int, content string")
    assert documents.rebuilt(rows).first()["text"] == "abcdef\nz"


def test_retry_algebra(spark):
    rows = spark.createDataFrame([(k, "IN_PROGRESS", 5 if k == 3 else 1, 2 if k == 4 else 0, None) for k in range(7)] + [(9, "PENDING", 0, 0, None)], "id int, status string, attempts int, failed int, last_error string")
    told = spark.createDataFrame([(0, True, None, None), (1, False, "NONE", "e"), (2, False, "DEFERRED", "e"), (3, False, "DEFERRED", "e"), (4, False, "IMMEDIATE", "e"), (5, False, "IMMEDIATE", "e"), (6, False, "DEFERRED_UNCOUNTED", "e"), (9, True, None, None)], "id int, ok boolean, policy string, error string")
    got = {r["id"]: (r["status"], r["attempts"], r["failed"]) for r in lifecycle.resolve(rows, told, ["id"]).collect()}
    assert got == {0: ("COMPLETED", 1, 0), 1: ("FAILED", 1, 0), 2: ("RETRY", 1, 0), 3: ("FAILED", 5, 0), 4: ("FAILED", 1, 3), 5: ("PENDING", 1, 1), 6: ("RETRY", 0, 0), 9: ("PENDING", 0, 0)}


def test_steps():
    assert lifecycle.from_step("EXTRACT_RELATIONSHIPS") == ["EXTRACT_RELATIONSHIPS", "EXPORT_KNOWLEDGE"]
    assert lifecycle.next_step({"INGEST_DOCUMENTS"}) == "EXTRACT_ENTITIES" and lifecycle.next_step(set(lifecycle.STEPS)) is None
    assert [lifecycle.snapshot_state(*x) for x in ((None, {}), ({"a": 1}, {"a": 1}), ({"a": 1}, {"a": 1, "b": 2}), ({"a": 1}, {"a": 2}))] == ["NEW", "CURRENT", "EXTENDED", "OUTDATED"]


def test_symmetric_identity(spark):
    rows = spark.createDataFrame([("T", "ENDPOINTS", "b", "a", True, None, "1"), ("T", "ENDPOINTS", "a", "b", True, None, "2"), ("T", "NONE", "a", "b", False, None, "3"), ("T", "NONE", "a", "b", False, None, "4")], "relationship_type_name string, policy string, source_id string, target_id string, symmetric boolean, pk string, occurrence string")
    got = relationships.identified(rows).orderBy("occurrence").collect()
    assert got[0]["relationship_id"] == got[1]["relationship_id"] and got[0]["source_id"] == "a" and got[2]["relationship_id"] != got[3]["relationship_id"]


def test_viable_needs_both_ends(spark):
    ends = planning.both_ways(spark.createDataFrame([("R", "A", "B", "CHUNK", "DOCUMENT", True)], "relationship_type_name string, source_type string, target_type string, source_level string, target_level string, symmetric boolean"))
    here = spark.createDataFrame([(1, "CHUNK", "A"), (1, "DOCUMENT", "B"), (2, "CHUNK", "A"), (3, "CHUNK", "B"), (3, "DOCUMENT", "A")], "chunk_id int, context_level string, entity_type_name string")
    assert sorted(r["chunk_id"] for r in planning.viable(here, ends).collect()) == [1]


def test_pages_cover_all(spark):
    rows, seen, after = spark.createDataFrame([(k % 3, k) for k in range(10)], "a int, b int"), [], None
    while got := [tuple(r) for r in ordering.page(rows, ["a", "b"], after, 4).collect()]:
        seen, after = seen + got, got[-1]
    assert seen == sorted((k % 3, k) for k in range(10))


def test_files(spark, tmp_path):
    data = tmp_path / "data"
    (data / "sub" / ".hidden").mkdir(parents=True)
    for name, content in (("a.txt", b"\xef\xbb\xbfone"), ("b.md", b"no"), ("~c.txt", b"no"), ("d.txt", b"\xff"), ("e.txt", b" \n"), ("sub/f.txt", b"two"), ("sub/.hidden/g.txt", b"no")):
        (data / name).write_bytes(content)
    (tmp_path / "out.txt").write_bytes(b"outside")
    (data / "link.txt").symlink_to(tmp_path / "out.txt")
    texts = lambda mode: sorted(r["text"] for r in files.scan(spark, f"file://{data}", {"root": ".", "mode": mode}).collect())
    assert texts("directory") == ["one"] and texts("recursive") == ["one", "two"]
    one = files.scan_registry(spark, f"file://{data}", {"x": [{"root": "a.txt", "mode": "file"}], "y": [{"root": ".", "mode": "recursive"}]})
    assert sorted((r["collection_name"], r["text"]) for r in one.collect()) == [("x", "one"), ("y", "one"), ("y", "two")]
    with pytest.raises(files.SourceError, match="outside.*not found"):
        files.check_sources([{"root": "..", "mode": "directory"}, {"root": "zz.txt", "mode": "file"}], str(data))
    assert files.without_redundant([{"root": "a", "mode": "recursive"}, {"root": "a/b.txt", "mode": "file"}, {"root": "c", "mode": "directory"}]) == [{"root": "a", "mode": "recursive"}, {"root": "c", "mode": "directory"}]
    stored = spark.createDataFrame(one.select("source_uri", "content_id").distinct().collect())
    old, bad = files.reload_checked(spark, stored, str(data))
    (data / "a.txt").write_bytes(b"changed")
    assert (old.count(), bad.count()) == (1, 1)


def test_normalised_text_keeps_spaces(spark):
    assert spark.createDataFrame([("a b",)], "t string").select(normalize_text(F.col("t"))).first()[0] == "a b"


def test_bootstrap_interval(spark):
    import numpy as np

    from kgforge.operators import evaluation

    rng = np.random.default_rng(0)
    counts = [(int(rng.integers(0, 6)), int(rng.integers(0, 3)), int(rng.integers(0, 3)), k) for k in range(150)]
    got = evaluation.bootstrap(spark.createDataFrame(counts, "tp long, fp long, fn long, id long"), 400).first()
    x = np.array(counts)[:, :3]
    drawn = x[rng.integers(0, len(x), (2000, len(x)))].sum(1)
    f1 = 2 * drawn[:, 0] / (2 * drawn[:, 0] + drawn[:, 1] + drawn[:, 2])
    assert abs(got["f1_low"] - np.quantile(f1, 0.025)) < 0.02 and abs(got["f1_high"] - np.quantile(f1, 0.975)) < 0.02


def test_filters_causes_and_pages_of_nothing(spark):
    from kgforge.operators import evaluation, metrics

    none = spark.createDataFrame([], "job_status string, created_at long, finished_at long")
    assert metrics.durations(none, "job_status").count() == 0 and metrics.wall_clock(none).first()["n_jobs"] == 0
    assert evaluation.micro(spark.createDataFrame([], "tp long, fp long, fn long")).first()["f1"] is None
    jobs = spark.createDataFrame([("F", 0, None), ("F", 0, 10), ("O", 5, None)], "job_status string, created_at long, finished_at long")
    assert {r["job_status"]: r["avg_ms"] for r in metrics.durations(jobs, "job_status").collect()} == {"F": 10, "O": 0}


def test_many_lines_and_chunks_take_linear_time(spark):
    text = "\n".join(f"line {k}" if k % 10 else " " for k in range(100_000))
    began = time.perf_counter()
    frame = spark.createDataFrame([("a", text), ("b", "x\n\ny"), ("c", ""), ("d", None)], "content_id string, text string")
    chunks = documents.line_chunks(frame).select("content_id", "chunk_index", "start_offset", "end_offset", "content").cache()
    rows = sorted((r for r in chunks.collect()), key=lambda r: (r["content_id"], r["chunk_index"]))
    own = [r for r in rows if r["content_id"] == "a"]
    assert len(own) == 90_000 and all(text[r["start_offset"] : r["end_offset"]] == r["content"] for r in own)
    assert [tuple(r)[1:4] for r in rows if r["content_id"] != "a"] == [(0, 0, 1), (1, 3, 4)]
    whole = {r["content_id"]: r["text"] for r in documents.rebuilt(chunks).collect()}
    assert whole["a"] == "\n".join(x for x in text.split("\n") if x.strip()) and whole["b"] == "x\ny" and time.perf_counter() - began < 60


def test_totals_before(spark):
    rows = [([],), ([5],), (list(range(300)),)]
    got = spark.createDataFrame(rows, "x array<int>").select(documents.totals_before(F.col("x")).alias("t")).collect()
    assert [list(r["t"]) for r in got] == [[sum(x[:k]) for k in range(len(x))] for (x,) in rows]
