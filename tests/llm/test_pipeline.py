import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgforge.llm import line_dedup, mixing, toxicity
from kgforge.llm.common import materialise, table

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables")


def test_stages_in_turn(spark):
    docs = table(spark, ROOT, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, ROOT), "stage")
        assert name == "mixing" or out.columns == columns
        ids, n = {r["doc_id"] for r in docs.select("doc_id").collect()}, out.count()
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids and (name in ("line_dedup", "mixing")) <= (n == sizes[-1])
        if name == "line_dedup":
            # what the stage keeps is what the query of the operator says
            says = {r["doc_id"]: r["kept_sha256"] for r in line_dedup.op2(docs).collect()}
            assert {r["doc_id"]: r["h"] for r in out.select("doc_id", F.sha2("text", 256).alias("h")).collect()} == says
        if name == "minhash":
            assert out.select("text").distinct().count() >= n - out.where("text = ''").count()
        if name == "mixing":
            assert sorted(r["position"] for r in out.collect()) == list(range(n)) and set(mixing.ADDED) <= set(out.columns)
        docs = out
        sizes.append(n)
    assert sizes[-1] > 0.5 * sizes[0]


def test_toxic_documents_go(spark):
    docs = table(spark, ROOT, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, ROOT).collect()}
    scored = toxicity.ToxicityModel(docs, table(spark, ROOT, "labels")).score(docs).collect()
    assert kept == {r["doc_id"] for r in scored if r["score"] < corpus_pipeline.TOXIC}


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, ROOT, name).limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def planted(seed=7):
    """Documents of known fate, and what a plain reading of the stages leaves of them."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(["an", "the", "ing", "or", "ed", "st", "re", "ka", "lo"], k=rng.randrange(1, 5))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    line = "One line of well over forty characters that many documents repeat"
    items = [(k, prose(rng.randrange(6, 50))) for k in range(20)]
    rows, fate, toxic = [], {}, {}

    def add(text, fate_, bad=0):
        doc = len(rows)
        rows.append((doc, text, "en", f"s{doc % 3 if doc % 4 else 9}", len(text)))
        fate[doc], toxic[doc] = fate_, bad
        return doc

    for k in range(700):
        add("\n".join([prose(rng.randrange(30, 80)), *([line] if k % 50 == 3 else []), prose(20)]), "line" if k % 50 == 3 else "stays")
    for _ in range(200):
        words = prose(rng.randrange(30, 80)).split()
        for _ in range(6):
            words[rng.randrange(len(words))] = "zorb" + rng.choice(vocabulary)
        add(" ".join(words), "toxic", 1)
    for k in range(20):
        add(f"{prose(40)} {items[k][1].upper()} {prose(40)}", "leak")
    for k in range(15):
        base = prose(120).split()
        for n in range(3):
            own = list(base)
            for _ in range(n):
                own[rng.randrange(len(own))] = prose(1)
            add(" ".join(own), "stays" if n == 0 else "copy")
    last = max(d for d, f in fate.items() if f == "line")
    labels = [(d, 1, t) for d, t in toxic.items()]
    return rows, labels, items, fate, line, last


def test_planted_documents_meet_their_fate(spark, tmp_path):
    rows, labels, items, fate, line, last = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    of = lambda kind: {d for d, f in fate.items() if f == kind}
    assert not got.keys() & (of("leak") | of("copy"))
    assert len(got.keys() & of("toxic")) <= 0.03 * len(of("toxic")) and of("stays") | of("line") <= got.keys()
    texts = {r[0]: r[1] for r in rows}
    for d in of("stays") | of("line"):
        want = texts[d] if fate[d] == "stays" or d == last else "\n".join(x for x in texts[d].split("\n") if x != line)
        assert got[d]["text"] == want and got[d]["n_chars"] == len(want)
    assert sorted(r["position"] for r in got.values()) == list(range(len(got)))
    # the mixture keeps every source within a block of its share, until one runs out
    per = {}
    for r in got.values():
        per[r["source"]] = per.get(r["source"], 0) + 1
    total, first = sum(n**0.5 for n in per.values()), [r for r in got.values() if r["phase"] == 0]
    for t in range(1, max(r["slot"] for r in first) + 2):
        for s, n in per.items():
            assert abs(len({r["slot"] for r in first if r["source"] == s and r["slot"] < t}) - n**0.5 / total * t) < 1
