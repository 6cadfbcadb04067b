import random
import re

import numpy as np
import pyarrow as pa

from kgforge.llm import near_dup
from kgforge.llm.common import word_hashes


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def corpus():
    rng, rows, n = random.Random(3), [], 0
    for group in range(12):
        base = words(rng, rng.randrange(60, 200))
        for k in range(rng.choice([1, 2, 3, 9])):
            own = list(base)
            for _ in range(k % 3):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9000)}"
            rows.append((n, " ".join(own)))
            n += 1
        rows.append((n, rows[-1][1].upper() + "  !"))
        n += 1
    shared = words(rng, 60)
    rows += [(n + k, " ".join(words(rng, 100) + shared)) for k in range(15)]
    return rows


def brute(rows, least=0.8):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {doc}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def test_classes_match_brute_force(spark):
    rows = corpus()
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_copies_of_copies_in_a_large_family(spark):
    rng = random.Random(5)
    base, edits = [f"b{k}" for k in range(200)], [f"e{k}" for k in range(300)]

    def edited(text, n):
        own = list(text)
        for k in rng.sample([k for k in range(200) if own[k][0] == "b"], n):
            own[k] = rng.choice(edits)
        return own

    first = [edited(base, 4) for _ in range(400)]
    # near one of the family only: 18 more words of 200 go
    texts = first + [edited(rng.choice(first), 18) for _ in range(80)]
    # others that hold all words of edits, so all words of the family weigh about alike
    texts += [edits + [f"o{n}x{k}" for k in range(300)] for n in range(400)]
    rows = list(enumerate(" ".join(t) for t in texts))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=1).collect()}
    sets = [frozenset(t) for t in texts]
    root = list(range(len(sets)))
    find = lambda d: d if root[d] == d else find(root[d])
    for a in range(480):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {d: find(d) for d in range(len(sets))}


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, "..."), (5, "a b"), (6, "A b!"), (7, "a"), (None, "a b"), (5, "a b"), (8, "long " * 200_000), (9, "long " * 200_000)]
    got = [(r["doc_id"], r["class_id"]) for r in near_dup.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and dict(got) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, None: None, 8: 8, 9: 8}
    assert near_dup.op4(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = near_dup.keep_one(spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y"), (None, "a b", "z")], "doc_id long, text string, class_id string"))
    assert kept.columns == ["doc_id", "text", "class_id"] and {r["class_id"] for r in kept.collect()} == {"x", "z"}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    a, b = rng.integers(1, 9, 300).astype(np.float32), rng.integers(1, 9, 300).astype(np.float32)
    a[:60], b[60:90] = 0, 0
    order = np.argsort(h)
    h, a, b = h[order], a[order], b[order]
    sampler = near_dup.Sampler(4000)
    agree = (sampler.samples(h[a > 0], a[a > 0]) == sampler.samples(h[b > 0], b[b > 0])).mean()
    assert abs(agree - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_word_hashes():
    texts = [None, "", "Ab ab_c-AB", "é x", "x", "...", "y" * 3000 + " z"]
    h, bounds = word_hashes(pa.array(texts))
    own = [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(x) for x in own] == [0, 0, 3, 2, 1, 0, 2] and own[2][0] == own[2][2] and own[3][1] == own[4][0]
    assert word_hashes(pa.array([], pa.string()))[1].tolist() == [0]
    sliced, at = word_hashes(pa.array(texts).slice(2, 2), at_once=2)
    assert sliced.tolist() == own[2] + own[3] and at.tolist() == [0, 3, 5]


def test_weights_are_exact_for_frequent_shingles_and_alike_for_rare_ones(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{int(300 * rng.random() ** 3)}" for _ in range(rng.randrange(0, 40))) for _ in range(900)]
    df, n = {}, sum(bool(t) for t in texts)
    for t in texts:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    got = near_dup.weights(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7), size=1, rarest=20)
    for w, k in df.items():
        h = near_dup.shingles(near_dup.shingle_stream(pa.array([w]), 1), 0, 1)[0]
        assert abs(got(h)[0] - np.log1p(min(n / k, 20))) < 1e-5
    assert len(got.keys) == sum(k >= n / 20 for k in df.values())


def test_links_match_all_pairs_by_weighted_similarity(spark):
    rng = random.Random(8)
    common = [words(rng, 30) for _ in range(3)]
    texts = []
    for _ in range(60):
        base = words(rng, rng.randrange(40, 120)) + rng.choice(common)
        for k in range(rng.choice([1, 2, 4])):
            own = list(base)
            for _ in range(rng.randrange(0, 5) if k else 0):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9000)}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    stream = near_dup.shingle_stream(pa.array(texts))
    found = [near_dup.shingles(stream, i) for i in range(len(texts))]
    df = {}
    for h, _ in found:
        for x in h.tolist():
            df[x] = df.get(x, 0) + 1
    weigh = [dict(zip(h.tolist(), (n * np.log1p([min(len(texts) / df[x], 1000) for x in h.tolist()])).tolist(), strict=True)) for h, n in found]

    def similar(a, b):
        both = a.keys() & b.keys()
        low = sum(min(a[x], b[x]) for x in both)
        plain = len(both) / len(a.keys() | b.keys())
        return max(low / (sum(a.values()) + sum(b.values()) - low), plain)

    got = {r["doc_id"]: r["class_id"] for r in near_dup.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = [(a, b) for a in range(len(texts)) for b in range(a) if similar(weigh[a], weigh[b]) >= 0.8]
    assert len(links) > 60 and all(got[a] == got[b] for a, b in links)
    root = list(range(len(texts)))
    find = lambda d: d if root[d] == d else find(root[d])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {d: find(d) for d in range(len(texts))}


def test_equal_rows_leave_one(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "other words here", "y"), (2, "a B c", "z"), (None, "n", "u"), (None, "n", "u")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, class_id string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5]]))
