import random

from kgforge.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n=1200):
    rng, docs, labels = random.Random(4), [], []
    words = ["".join(rng.choices(["ka", "lo", "mi", "tu"], k=rng.randrange(1, 4))) for _ in range(500)]
    for k in range(n):
        good = rng.random() < 0.7
        text = " ".join(w if good else w + rng.choice(["###", "$$$", ""]) for w in rng.choices(words, k=rng.randrange(20, 90)))
        docs.append((k, text, "en", "good" if good and rng.random() < 0.8 else f"s{k % 5}", len(text), "x"))
        if k % 2:
            labels.append((k, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(5000, None, None, None, None, "x"), (5001, "", "en", "", 0, "x"), (None, "a", "b", "c", 1, "x"), (1, docs[1][1], "en", "s", -3, "x"), (5002, "w " * 200_000, "en", "s", 400_000, "x")]
    got = quality.op7(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.93 * len(held)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a", "b", "c", 1, "x")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.op7(docs, none).first()["score"] == 0.5 and quality.op7(docs.limit(0), none).count() == 0


def test_views_teach_each_other_from_all_unlabelled_rows(spark):
    """One round against the same steps by hand: every unlabelled text is scored, equal ones teach once, held-out ones never."""
    import zlib

    import numpy as np

    docs, labels = corpus(400)
    docs += [(1000 + k, docs[0][1], "en", f"copy{k}", 5, "x") for k in range(50)] + [(2000, None, None, None, None, "x")]
    views = quality.view_table(spark.createDataFrame(docs, DOCS))
    model = quality.CoTraining(views, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rounds=1, sure=10)
    held = {d for d, *_ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    truth = {d: q for d, q, _ in labels if d not in held}
    table = views.toArrow()
    rows, ids, own = quality.Rows(table).views, table["doc_id"].to_pylist(), table["own"].to_pylist()
    known = sorted((d, i) for i, d in enumerate(ids) if d in truth)
    train = [x for k, x in enumerate(known) if k % quality.CURVE_FOLD]
    y = np.array([truth[d] for d, _ in train], float)
    free = [i for i, d in enumerate(ids) if d not in held and d not in {x for x, *_ in labels}]
    fitted = [quality.Logistic([rows[k][i] for _, i in train], y, size) for k, size in ((0, 1 << quality.BITS), (1, quality.META))]
    taught = [[], []]
    for k in (0, 1):
        best = {}
        for i in free:
            o = fitted[k].odds(*rows[k][i], np.array([0, len(rows[k][i][0])]))[0]
            best[own[i]] = max(o, best.get(own[i], -np.inf))
        low = max(1, round(10 * (1 - y.mean())))
        order = sorted(best, key=lambda x: (best[x], x))
        up = sorted(best, key=lambda x: (-best[x], x))[: max(1, 10 - low)]
        taught[1 - k] = [(x, 0) for x in order[:low]] + [(x, 1) for x in up if x not in order[:low]]
    for k, size in ((0, 1 << quality.BITS), (1, quality.META)):
        pick = lambda x: min((table["meta"][i].as_py(), i) for i in free if own[i] == x)[1]
        want = quality.Logistic([*(rows[k][i] for _, i in train), *(rows[k][pick(x)] for x, _ in taught[k])], np.r_[y, [v for _, v in taught[k]]], size)
        assert np.allclose(want.w, model.models[k].w, atol=1e-5) and abs(want.b - model.models[k].b) < 1e-6


def test_probabilities_of_a_batch_are_those_of_its_rows(spark):
    import numpy as np

    docs, labels = corpus(200)
    docs[5] = (5, "", "en", "s", 0, "x")
    views = quality.view_table(spark.createDataFrame(docs, DOCS))
    model = quality.CoTraining(views, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    batch = views.toArrow().combine_chunks().to_batches()[0]
    whole = model.probabilities(batch)
    assert all(np.allclose(whole[i], model.probabilities(batch.slice(i, 1))[0]) for i in range(0, batch.num_rows, 13))
