import math
import random
import zlib

from kgforge.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, score int"


def corpus(n=2400):
    rng, docs, labels = random.Random(5), [], []
    ordinary = ["".join(rng.choices(["an", "the", "ing", "or", "ed", "st", "re"], k=rng.randrange(1, 5))) for _ in range(900)]
    for k in range(n):
        text = rng.choices(ordinary, k=rng.randrange(20, 80))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(len(text))] = "zorb" + rng.choice(ordinary)
        docs.append((k, " ".join(text), "en", "s", 7))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(10_001, None, None, None, 7), (10_002, "", None, None, 7), (10_003, "!!! 123", None, None, 7), (10_004, "the " * 300_000, None, None, 7), (None, "zorban", None, None, 7), (3, docs[3][1], "x", "y", 7)]
    got = toxicity.op5(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[10_001] == by[10_002] == by[10_003]


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(600)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    scores = [sorted(map(tuple, toxicity.op5(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a", "b", "c", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.op5(docs, none).first()["score"] == 0
    assert toxicity.op5(docs.limit(0), none).count() == 0


def test_probabilities_add_up(spark):
    rows = spark.createDataFrame([("abba abc", 0), ("bac cab", 0), ("abz", 1)], "text string, toxic int")
    top = toxicity.gram_counts(rows, 3)
    backoff = {r["s"]: r["p"] for r in toxicity.shared_backoff(top, 3).collect()}
    for ctx in {s[0] for s in backoff}:
        assert sum(p for s, p in backoff.items() if s[0] == ctx) <= 1 + 1e-9


def brute_ratio(texts, order=5, d=0.75):
    """Log-likelihood ratio by word, straight from the definition of Kneser-Ney estimates, over (text, toxic)."""
    counts = [{}, {}]
    for text, toxic in texts:
        for w in text.lower().split():
            for g in toxicity.grams(w, order):
                counts[toxic][g] = counts[toxic].get(g, 0) + 1
    kinds = {g for c in counts for g in c}
    levels = {order: kinds}
    for k in range(order - 1, 0, -1):
        levels[k] = {g[1:] for g in levels[k + 1]}
    continuations = {k: {} for k in range(1, order)}
    for k in range(1, order):
        for g in levels[k + 1]:
            continuations[k][g[1:]] = continuations[k].get(g[1:], 0) + 1

    def shared(s):
        own = continuations[len(s)]
        if len(s) == 1:
            return own.get(s, 0) / sum(own.values())
        same = [n for t, n in own.items() if t[:-1] == s[:-1]]
        return (own[s] - d + d * len(same) * shared(s[1:])) / sum(same)

    def estimate(g, c):
        same = [n for t, n in counts[c].items() if t[:-1] == g[:-1]]
        low = shared(g[1:])
        return (max(counts[c].get(g, 0) - d, 0) + d * len(same) * low) / sum(same) if same else low

    def rest(ctx, c):
        same = [n for t, n in counts[c].items() if t[:-1] == ctx]
        return d * len(same) / sum(same) if same else 1.0

    def ratio(word):
        total = 0.0
        for g in toxicity.grams(word, order):
            if g in kinds:
                total += math.log(estimate(g, 1) / estimate(g, 0))
            elif any(t[:-1] == g[:-1] for t in kinds):
                total += math.log(rest(g[:-1], 1) / rest(g[:-1], 0))
        return total

    return ratio


def test_ratios_are_those_of_the_definition_and_joins_give_the_same(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choices(["abba", "bacab", "cab", "abacus", "bab", "zork"], k=9)), "", "", 0) for k in range(160)]
    labels = [(k, 1, int("zork" in t and rng.random() < 0.8)) for k, t, *_ in docs]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.ToxicityModel(*frames)
    used = lambda k: zlib.crc32(str(k).encode()) % 4 != 2 and zlib.crc32(str(k).encode()) // 4 % toxicity.CURVE_FOLD != 0
    want = brute_ratio([(t, labels[k][2]) for k, t, *_ in docs if used(k)])
    got = toxicity.WordRatios(*model.tables.value)
    for w in ["abba", "bacab", "zork", "zorkab", "new", "abaz", "q"]:
        assert abs(got[w] - want(w)) < 1e-4
    odd = spark.createDataFrame([*docs, (1, None, "", "", 0), (2, "", "", "", 0), (3, "zork new words", "", "", 0), (3, "zork new words", "", "", 0)], DOCS)
    joined = toxicity.ToxicityModel(*frames, most=0)
    assert joined.tables is None
    a, b = (sorted(tuple(r) for r in m.score(odd.select("doc_id", "text", "lang")).select("doc_id", "lang", "score").collect()) for m in (model, joined))
    assert len(a) == len(b) == 164 and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 for x, y in zip(a, b, strict=True))
