import math
import random
import re

from kgforge.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(ASCII))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


CASES = [
    (1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. mit license MIT-LICENSE"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."),
    (5, None), (6, ""), (7, "the mit and a license"), (8, "MİT license É general public license"), (9, "x " * 100_000 + "general public general public license"), (10, "license mit"), (11, "Permission is hereby granted, free of charge, to any person obtaining a copy of this program"),
    (None, "mit license"), (1, "Released under the MIT License."), (12, "mit\x7flicense|general\npublic\tlicense"),
]


def test_base_matches_brute_force(spark):
    rows = spark.createDataFrame([(d, t, 3, "x") for d, t in CASES], "doc_id long, text string, score int, labels string")
    got = licenses.op6(rows).collect()
    own = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str)
    assert own == sorted(((d, *brute(t)) for d, t in CASES), key=str)
    labels = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in got}
    assert labels[1] == ("mit", 1.0) and labels[2] == ("apache,mit", 1.0) and labels[4] == ("cc-by-nc", 1.0) and labels[10] == ("", 0.0) and labels[5] == ("", 0.0)
    assert labels[11][0] == "mit" and 0.8 <= labels[11][1] < 1
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def test_empty_table(spark):
    assert licenses.op6(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_document_frequency(spark):
    rows = spark.createDataFrame([("mit mit x",), ("MIT",), (None,), ("y",)], "text string")
    assert licenses.document_frequency(rows, ["mit", "z"]) == (4, {"mit": 2})


def all_starts(text, idf):
    """Brute force: every template at every start, without an index."""
    words, out = WORD.findall((text or "").translate(ASCII)), set()
    at = lambda i: words[i] if 0 <= i < len(words) else None
    for label, notice, phrase in licenses.TEMPLATES:
        parts = notice.split()
        begin = next(k for k in range(len(parts)) if parts[k : k + len(phrase.split())] == phrase.split())
        for start in range(-len(parts), len(words)):
            share = sum(idf[w] for k, w in enumerate(parts) if at(start + k) == w) / sum(idf[w] for w in parts)
            if share >= licenses.LEAST and all(at(start + begin + k) == w for k, w in enumerate(phrase.split())):
                out.add((label, round(min(1, share), 6)))
    return out


def test_templates_match_every_start(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        words = rng.choices(licenses.vocabulary() + ["x", "y", "lorem"], k=rng.randrange(30))
        for _ in range(rng.randrange(3)):
            notice = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(3)):
                notice[rng.randrange(len(notice))] = rng.choice(["x", "the", "mit"])
            cut = rng.randrange(len(words) + 1)
            words[cut:cut] = notice[rng.randrange(2) :]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, df = licenses.document_frequency(docs, licenses.vocabulary())
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in licenses.vocabulary()}
    for r in licenses.op6(docs).collect():
        want = all_starts(texts[r["doc_id"]], idf)
        base = brute(texts[r["doc_id"]])[4]
        assert r["labels"] == ",".join(sorted({x for x, _ in want} | set(filter(None, base.split(","))))), texts[r["doc_id"]]
        assert r["score"] == (1 if base else max((x for _, x in want), default=0))


def test_plan_has_no_python(spark):
    plan = licenses.op6(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
