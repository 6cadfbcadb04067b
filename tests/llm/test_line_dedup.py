import hashlib
import os
import random
import time

from kgforge.llm import line_dedup
from pyspark.sql import functions as F

LONG = "The same line of more than forty characters, again"
BLANKS = " \t\n\x0b\x0c\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(ASCII)
            if len(key) >= 40 and doc is not None:
                held.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        key = lambda x: x.strip(BLANKS).translate(ASCII)
        kept = [x for x in lines if doc is None or len(held.get(key(x), ())) < 5 or max(held[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(k, f"own {k}\n{'  ' if k % 2 else ''}{LONG.upper() if k % 3 else LONG}\t\nend") for k in range(7)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, LONG + "\n" + LONG), (24, "x" * 200_000 + "\n" + LONG), (None, LONG), (3, rows[3][1]), (25, "É" * 40), (26, "é" * 40)]
    got = line_dedup.op2(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.op2(empty).count() == 0
    rows = spark.createDataFrame([(k, LONG, "a", k) for k in range(5)], "doc_id long, text string, keep_doc string, line_no int")
    out = line_dedup.dedup_lines(rows)
    assert out.columns == ["doc_id", "text", "keep_doc", "line_no", "n_lines", "n_dropped"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "", 1: "", 2: "", 3: "", 4: LONG}


def test_runs_mark_new_keys_and_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda *rows: spark.createDataFrame(rows, "h1 long, h2 long, doc_id long")
    assert runs.add(batch((1, 1, 1), (2, 2, 1))).where("fresh").count() == 2
    again = runs.add(batch((2, 2, 5), (3, 3, 5)))
    assert [r["h1"] for r in again.where("fresh").collect()] == [3]
    runs.add(batch((2, 2, 7)))
    assert [len(x) for x in runs.levels] == [1, 1]
    total = {r["h1"]: (r["n_docs"], r["keep_doc"]) for r in runs.all_keys().where(F.col("h1") > 0).collect()}
    assert total == {1: (1, 1), 2: (3, 7), 3: (1, 5)}


def test_runs_are_read_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, fanout=3, buckets=3)
    rng = random.Random(2)
    counts = {}
    for b in range(4):
        rows = [(rng.randrange(40), 7, 1000 * b + rng.randrange(30)) for _ in range(120)]
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long"))
        for h, _, d in set(rows):
            counts.setdefault(h, []).append(d)
    assert [len(x) for x in runs.levels] == [1, 1]
    got = {r["h1"]: (r["n_docs"], r["keep_doc"]) for r in runs.all_keys().collect()}
    assert got == {h: (len(d), max(d)) for h, d in counts.items()}
    assert {r["h1"]: r["n_docs"] for r in runs.repeated(9).collect()} == {h: len(d) for h, d in counts.items() if len(d) >= 9}
    plan = runs.all_keys()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    folder = runs.root
    runs.drop()
    assert not os.path.exists(folder.removeprefix("file://")) and not {t.name for t in spark.catalog.listTables()} & set(runs.tables)


def test_many_lines_take_linear_time(spark):
    rows = [(d, "\n".join([LONG, *(f"line {k} of document {d}" for k in range(100_000))])) for d in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").cache()
    frame.count()
    began = time.perf_counter()
    got = line_dedup.op2(frame).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got) == [(d, 100_001, int(d < 5)) for d in range(6)]
    assert time.perf_counter() - began < 40
