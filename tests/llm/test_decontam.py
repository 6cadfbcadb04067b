import random

import numpy as np

from kgforge.llm import decontam

ITEMS, DOCS = "item_id long, text string", "doc_id long, text string, items string"


def corpus():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices(["ka", "lo", "mi", "tu", "re", "sa"], k=rng.randrange(1, 5))) for _ in range(3000)]
    common = vocabulary[:40]
    sentence = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n))
    items = [(k, sentence(rng.randrange(12, 60)) + ". " + sentence(6) + ".") for k in range(30)]
    docs, want = [], {}
    for d in range(300):
        parts = [sentence(rng.randrange(30, 200)), sentence(50)]
        if d % 10 == 0:
            k = rng.randrange(30)
            text = items[k][1]
            if d % 20 == 0:  # a paraphrase: one word in eight is another
                text = " ".join(rng.choice(vocabulary) if i % 8 == 3 else w for i, w in enumerate(text.split()))
            parts.insert(1, text.upper() if d % 30 == 0 else text)
            want.setdefault(d, set()).add(k)
        docs.append((d, "\n".join(parts), "x"))
    return items, docs, want


def test_planted_passages_and_clean_documents(spark):
    items, docs, want = corpus()
    got = {r["doc_id"]: set(r["items"]) for r in decontam.op9(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert not got.keys() - want.keys()
    assert sum(got.get(d) == w for d, w in want.items()) >= len(want) - 1
    kept = decontam.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert kept.columns == ["doc_id", "text", "items"] and kept.count() == len(docs) - len(got)


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, None, ""), (2, "", ""), (3, text, ""), (4, "a " * 100_000 + text, ""), (3, text, ""), (None, "short item", ""), (5, "this short item here", ""), (6, "short other item", "")]
    items = [(1, text), (2, None), (3, ""), (4, "Short item"), (4, "Short item"), (None, text)]
    got = {r["doc_id"]: r["items"] for r in decontam.op9(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {3: [1], 4: [1], None: [4], 5: [4]}
    none = spark.createDataFrame([], ITEMS)
    assert decontam.op9(spark.createDataFrame(docs, DOCS), none).count() == 0
    assert decontam.op9(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0


def test_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(12))], [rng.randrange(4) for _ in range(rng.randrange(12))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontam.lcs(a, b) == table[-1, -1]


def test_product_is_that_of_the_passages():
    rng = np.random.default_rng(0)
    words, starts = np.where(rng.random(40) < 0.5, 3, rng.integers(0, 16, 40)).astype(np.uint16), np.array([0, 10, 25])
    g, z, n = rng.standard_normal((16, 3)).astype(np.float32), np.zeros((16, 3), np.float32), np.zeros(16, np.int64)
    decontam.multiply_passages(words, starts, np.vstack([g, np.zeros((1, 3), np.float32)]), z, n)
    counts = np.stack([np.bincount(x, minlength=16) for x in np.split(words, starts[1:])])
    assert np.allclose(z, counts.T @ (counts @ g), atol=1e-3) and (n == (counts > 0).sum(0)).all()


def test_singular_values_and_vectors_are_those_of_the_matrix(spark):
    rng = random.Random(5)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(6)]
    texts = [" ".join(rng.choice(topics[d % 6]) if rng.random() < 0.8 else f"x{rng.randrange(400)}" for _ in range(rng.randrange(1, 150))) for d in range(240)]
    bits, passage = 9, 20
    idf, v, s = decontam.singular(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), bits, 5, passage)
    rows = []
    for words in decontam.words_of(texts):
        for a in range(0, len(words), passage):
            rows.append(np.bincount([w % (1 << bits) for w in words[a : a + passage]], minlength=1 << bits))
    t = np.array(rows, float)
    assert np.allclose(idf, np.log((len(t) + 1) / ((t > 0).sum(0) + 1)) + 0.05)
    _, want, right = np.linalg.svd(t * idf, full_matrices=False)
    assert np.allclose(s, want[:5], rtol=0.03) and np.allclose(v.T @ v, np.eye(5), atol=1e-6)
    # the two spaces are the same: cosines of the angles between them
    assert np.linalg.svd(v.T @ right[:5].T)[1].min() > 0.95


def every_window(texts, items):
    """Brute force: each item against the words from every word of every text on."""
    out = set()
    for d, words in enumerate(decontam.words_of(texts)):
        for (item_id, text), item in zip(items, decontam.words_of([t for _, t in items]), strict=True):
            answer, reach = decontam.answer_of(text), len(item) + len(item) // 4
            if any(decontam.within(item, answer, words[a : a + reach]) for a in range(0, max(1, len(words) - len(item) // 2))):
                out.add((d, item_id))
    return out


def test_recall_of_edited_items_against_every_window(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices(["ka", "lo", "mi", "tu", "re", "sa", "no"], k=rng.randrange(1, 5))) for _ in range(2500)]
    word = lambda: vocabulary[int(len(vocabulary) * rng.random() ** 2)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 60))) + ".") for k in range(60)]

    def edited(text, share):
        out = []
        for w in text.split():
            if rng.random() >= share:
                out.append(w)
            elif (x := rng.random()) < 0.4:
                out.append(word())
            elif x < 0.7:
                out += [w, word()]
        return " ".join(out)

    texts = []
    for share in (0, 0.1, 0.2, 0.3):
        texts += [" ".join([*(word() for _ in range(rng.randrange(80))), edited(t, share), *(word() for _ in range(rng.randrange(80)))]) for _, t in items]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], k) for r in decontam.matches(docs, spark.createDataFrame(items, ITEMS)).collect() for k in r["items"]}
    want = every_window(texts, items)
    assert {(d, d % 60) for d in range(60)} <= got  # unchanged
    for share, least in enumerate((1, 0.97, 0.95, 0.9)):
        own = {x for x in want if x[0] // 60 == share}
        assert len(own) > 40 and len(own & got) >= least * len(own), (share, len(own & got), len(own))


def test_rows_are_judged_by_their_own_text_and_blocks_change_nothing(spark):
    items, docs, want = corpus()
    docs = [(None if d in (10, 11) else d, t, x) for d, t, x in docs] + [(20, "another text of the same id", "x")]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    whole = sorted(map(str, decontam.matches(frame, bench).collect()))
    assert whole == sorted(map(str, decontam.matches(frame, bench, block_bytes=500).collect()))
    kept = [tuple(r) for r in decontam.clean(frame, bench, block_bytes=4000).collect()]
    assert docs[11] in kept and docs[10] not in kept and docs[-1] in kept and docs[20] not in kept
    assert sorted(map(str, kept)) == sorted(map(str, (tuple(r) for r in decontam.clean(frame, bench).collect())))


def test_every_copy_of_a_short_item_is_found(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(k, " ".join(word() for _ in range(5 + k % 10))) for k in range(300)]
    texts = []
    for k, item in items:
        own = [word() for _ in range(200)]
        at = rng.randrange(200)
        texts.append((k, " ".join([*own[:at], item, *own[at:]])))
    # the words of an item, but over the end of a text
    texts += [(1000, "x " + " ".join(items[0][1].split()[:3])), (1001, " ".join(items[0][1].split()[3:]) + " y")]
    got = decontam.matches(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r[0]: r[1] for r in got}
    assert all(k in found.get(k, []) for k, _ in items) and not {1000, 1001} & set(found)
