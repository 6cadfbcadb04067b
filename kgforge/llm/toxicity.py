"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Each class, toxic and ordinary, has its own counts of letter n-grams (words padded on the left, closed by an end mark). A class's
estimate discounts them by D and hands the rest to backoff estimates that both classes share: Kneser-Ney continuation counts of the
shorter n-grams, over all distinct n-grams of either class. So a rare expression is judged by the stem it shares with known ones. A
word's score is the log-likelihood ratio of the two models; a text is described by its length-normalised ratio, the ratios of its
strongest places and different words (each a window of one word), how many words are strong, and its length; a logistic curve over
these, fitted on a fold of the training rows that the counts leave out, gives the probability.

Every n-gram and context of the training rows has a ratio of its own, kept by a hash of 64 bits, so the tables grow with the corpus. Up to
`MOST` of them go to the workers; beyond that the words of the texts are joined with the tables, for the same scores.

Defined cases: a null or empty text has no words and gets the curve's value at all-zero features; labels that contradict each other
count as toxic, null ones are left out; without labels of both classes every score is 0; a null doc_id is never in training.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import BASE, MIX, crc_mod4, held_out, materialise, release, small_batches

WORD = re.compile(r"[^\W\d_]+")
PAD, END = "^", "$"
ORDER = 5
DISCOUNT = 0.75
#: Ratios that are sent to the workers (12 bytes each); more are joined.
MOST = 1 << 22
#: One row in so many of the training rows is for the curve, and at most so many documents of them are used.
CURVE_FOLD, CURVE_ROWS = 8, 20_000
#: Words that a worker remembers before it forgets them all.
MEMORY = 200_000
FEATURES = ["mean", "top1", "top2", "top3", "word1", "word2", "word3", "word4", "word5", "over2", "over3", "excess", "size"]


def grams(word: str, order: int = ORDER) -> list[str]:
    padded = PAD * (order - 1) + word + END
    return [padded[i : i + order] for i in range(len(word) + 1)]


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """g, c0, c1: n-gram counts of the two classes over rows (text, toxic)."""
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            out: dict[str, list[int]] = {}
            for k in (0, 1):
                for word, n in words[k].items():
                    for g in grams(word, order):
                        out.setdefault(g, [0, 0])[k] += n
                words[k].clear()
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([x[0] for x in out.values()], pa.int64()), pa.array([x[1] for x in out.values()], pa.int64())], names=["g", "c0", "c1"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if text:
                    words[toxic].update(WORD.findall(text.lower()))
            if len(words[0]) + len(words[1]) > MEMORY:
                yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(count, "g string, c0 long, c1 long").groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def shared_backoff(top: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """s, p: the shared Kneser-Ney estimate of each suffix of order - 1 characters, from continuation counts."""
    levels = {}
    below = top.select("g")
    for k in range(order - 1, 0, -1):
        levels[k] = below.groupBy(F.substr("g", F.lit(2)).alias("s")).agg(F.count("*").alias("n"))
        below = levels[k].select(F.col("s").alias("g"))
    total = levels[1].agg(F.sum("n").alias("all"))
    p = levels[1].crossJoin(F.broadcast(total)).select("s", (F.col("n") / F.col("all")).alias("p"))  # total: one row
    for k in range(2, order):
        rows = levels[k].withColumns({"ctx": F.substr("s", F.lit(1), F.lit(k - 1)), "low": F.substr("s", F.lit(2))})
        ctx = rows.groupBy("ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        p = rows.join(ctx.hint("merge"), "ctx").join(p.withColumnRenamed("s", "low").hint("merge"), "low").select("s", ((F.col("n") - discount + discount * F.col("kinds") * F.col("p")) / F.col("all")).alias("p"))
    return p


def ratios(top: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(g, n, llr) of every n-gram seen in either class, and (ctx, n, llr) for what was never seen after a context."""
    rows = top.withColumns({"ctx": F.substr("g", F.lit(1), F.lit(order - 1)), "s": F.substr("g", F.lit(2))})
    ctx = rows.groupBy("ctx").agg(*[f(f"c{k}") .alias(f"{name}{k}") for k in (0, 1) for f, name in ((F.sum, "all"), (lambda c: F.count_if(F.col(c) > 0), "kinds"))])
    rest = lambda k: F.when(F.col(f"all{k}") > 0, discount * F.col(f"kinds{k}") / F.col(f"all{k}")).otherwise(1.0)
    own = lambda k: F.when(F.col(f"all{k}") > 0, F.greatest(F.col(f"c{k}") - discount, F.lit(0.0)) / F.col(f"all{k}")).otherwise(0.0)
    p = rows.join(ctx.hint("merge"), "ctx").join(shared_backoff(top, order, discount).hint("merge"), "s")
    seen = p.select("g", (F.col("c0") + F.col("c1")).alias("n"), F.log((own(1) + rest(1) * F.col("p")) / (own(0) + rest(0) * F.col("p"))).alias("llr"))
    unseen = ctx.select("ctx", (F.col("all0") + F.col("all1")).alias("n"), F.log(rest(1) / rest(0)).alias("llr"))
    return seen, unseen


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` code points from each place on."""
    n = max(0, len(codes) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(BASE) + codes[k : k + n] + np.uint64(1)
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ h >> np.uint64(29)


def word_grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all words, of their contexts, and where each word's begin."""
    sizes = np.array([len(w) + 1 for w in words])
    codes = code_points("".join([PAD * (order - 1) + w + END for w in words]))
    starts = np.r_[0, np.cumsum(sizes)]
    # n-grams that begin in a word's end are of no word
    at = np.arange(starts[-1]) + np.repeat(np.arange(len(words)) * (order - 1), sizes)
    return rolled(codes, order)[at], rolled(codes, order - 1)[at], starts[:-1]


class Table:
    """Ratios by the hash of an n-gram or context, in sorted arrays; rows (s, llr), with s of `size` characters."""

    def __init__(self, rows: DataFrame, size: int) -> None:
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = rolled(code_points("".join(batch.column("s").to_pylist())), size)[::size]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("llr")], names=["h", "llr"])

        got = rows.mapInArrow(hashed, "h long, llr float").toArrow()  # MOST rows at most
        keys = got["h"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.llr = keys[order], got["llr"].to_numpy()[order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The ratios; NaN for those that aren't there."""
        if not len(self.keys):
            return np.full(len(h), np.nan)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.llr[at].astype(float), np.nan)


class WordRatios(dict):
    """Log-likelihood ratio by word, worked out from the two tables when a batch first brings it."""

    def __init__(self, seen: Table, unseen: Table, order: int = ORDER) -> None:
        super().__init__()
        self.seen, self.unseen, self.order = seen, unseen, order

    def learn(self, counts: list[Counter]) -> None:
        """Works out the words of these counts that aren't known yet."""
        if len(self) > MEMORY:
            self.clear()
        new = [w for w in set().union(*counts) if w not in self]
        for a in range(0, len(new), 50_000):
            words = new[a : a + 50_000]
            own, contexts, starts = word_grams(words, self.order)
            x = self.seen(own)
            left = np.flatnonzero(np.isnan(x))
            x[left] = self.unseen(contexts[left])
            self.update(zip(words, np.add.reduceat(np.nan_to_num(x), starts).tolist(), strict=True))

    def __missing__(self, word: str) -> float:
        self.learn([Counter([word])])
        return self[word]


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def features(own: list[tuple[float, int]]) -> list[float]:
    """Of (ratio, places) of a text's different words: ratio per word, the strongest places, the strongest different words, how many are strong, and size."""
    if not own:
        return [0.0] * len(FEATURES)
    own = sorted(own, reverse=True)
    size = sum(n for _, n in own)
    top = [x for x, n in own[:3] for _ in range(min(n, 3))][:3]
    different = [x for x, _ in own[:5]]
    clipped = lambda values, k: [max(0.0, x) for x in (values + [0.0] * k)[:k]]
    strong = [x for x, _ in own if x > 1]
    return [
        sum(x * n for x, n in own) / size, *clipped(top, 3), *clipped(different, 5),
        math.log1p(sum(x > 2 for x in strong)), math.log1p(sum(x > 3 for x in strong)), sum(x - 1 for x in strong) / math.sqrt(size), math.log1p(size),
    ]


def described(texts: list[str | None], ratio: WordRatios) -> np.ndarray:
    counts = [words_of(t) for t in texts]
    ratio.learn(counts)
    return np.array([features([(ratio[w], n) for w, n in c.items()]) for c in counts], float).reshape(-1, len(FEATURES))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, the last one its constant; x is scaled inside."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * np.r_[w[:-1], 0]
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.diag([1.0] * (len(w) - 1) + [1e-6]), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    scaled = w[:-1] / sd
    return np.r_[scaled, w[-1] - scaled @ mean]


class ToxicityModel:
    """seen, unseen: ratios by n-gram and context; tables: the same broadcast, None if they are too many; weights: of the curve, None if a class has no rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame, order: int = ORDER, most: int = MOST) -> None:
        spark = docs.sparkSession
        self.tables, self.weights, self.order = None, None, order
        given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        given = given.where(~held_out(F.col("doc_id")))
        texts = docs.where(F.col("doc_id").isNotNull() & (crc_mod4(F.col("doc_id")) != 2)).select("doc_id", "text")
        # by a merge at any size, as neither side has a bound
        rows = texts.join(given.hint("merge"), "doc_id").withColumn("curve", F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string")) / 4), F.lit(CURVE_FOLD)) == 0)
        rows = materialise(rows.select("doc_id", "text", "toxic", "curve"), "labelled")
        if rows.agg(F.count_distinct("toxic").alias("n")).first()["n"] < 2:
            return
        top = materialise(gram_counts(rows.where("NOT curve"), order), "grams")
        seen, unseen, grams_ = *ratios(top, order), top.count() // 8
        self.seen = materialise(seen.select(F.col("g").alias("s"), F.col("llr").cast("float").alias("llr")), "seen", grams_)
        self.unseen = materialise(unseen.select(F.col("ctx").alias("s"), F.col("llr").cast("float").alias("llr")), "unseen", grams_)
        if self.seen.count() + self.unseen.count() <= most:
            self.tables = spark.sparkContext.broadcast((Table(self.seen, order), Table(self.unseen, order - 1)))
            release(spark)
        for fold in (rows.where("curve"), rows):  # all, if there are too few rows for a fold of their own
            ids = fold.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS)
            # ids are CURVE_ROWS at most; the texts stay where they are, and equal ones count once
            sample = fold.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", "toxic").dropDuplicates(["doc_id", "text"])
            got = self.described(sample, ["toxic"]).orderBy("toxic", *FEATURES).toArrow()
            y = got["toxic"].to_numpy().astype(float)
            if len(np.unique(y)) == 2:
                break
        self.weights = fit_curve(np.column_stack([got[f].to_numpy() for f in FEATURES]), y)

    def described(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """The features of every row's text, and the columns to keep."""
        return self._mapped(rows, keep, lambda x: [x[:, k] for k in range(len(FEATURES))], FEATURES)

    def _curve(self):
        weights = self.weights
        return lambda x: [1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))]

    def _mapped(self, rows: DataFrame, keep: list[str], make, names: list[str]) -> DataFrame:
        """The kept columns and make(features of all rows of a batch)."""
        small_batches(rows.sparkSession)
        tables, order = self.tables, self.order
        schema = StructType([rows.schema[c] for c in keep] + [StructField(n, DoubleType()) for n in names])

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio = WordRatios(*tables.value, order)
            for batch in batches:
                x = described(batch.column("text").to_pylist(), ratio)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, make(x))], names=[*keep, *names])

        if tables:
            return rows.mapInArrow(near, schema)

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [[(w["llr"], w["n"]) for w in ws] for ws in batch.column("ws").to_pylist()]
                x = np.array([features(o) for o in own], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column("_t1"), batch.column("_t2"), *map(pa.array, make(x))], names=["_t1", "_t2", *names])

        scored = self._joined(rows).mapInArrow(far, "_t1 long, _t2 long, " + ", ".join(f"{n} double" for n in names))
        empty = [float(v[0]) for v in make(np.zeros((1, len(FEATURES))))]
        out = rows.join(scored.select(F.col("_t1"), F.col("_t2"), F.struct(*names).alias("_x")), (F.xxhash64("text") == F.col("_t1")) & (F.xxhash64(F.lit(2), "text") == F.col("_t2")), "left")
        return out.select(*[rows[c] for c in keep], *[F.coalesce(F.col(f"_x.{n}"), F.lit(e)).alias(n) for n, e in zip(names, empty, strict=True)])

    def _joined(self, rows: DataFrame) -> DataFrame:
        """_t1, _t2 (hash of the text) and ws (ratio and places of its different words), of every different text with words."""
        order = self.order

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts = [words_of(t) for t in batch.column("text").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
                yield pa.RecordBatch.from_arrays([batch.column("_t1").take(at), batch.column("_t2").take(at), pa.array([w for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=["_t1", "_t2", "word", "n"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [(w, g) for w in batch.column("word").to_pylist() for g in grams(w, order)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([g for _, g in own], pa.string())], names=["word", "g"])

        words = rows.select(F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(2), "text").alias("_t2"), "text").mapInArrow(split, "_t1 long, _t2 long, word string, n long")
        words = materialise(words.groupBy("_t1", "_t2", "word").agg(F.max("n").alias("n")), "words")
        places = words.select("word").distinct().mapInArrow(cut, "word string, g string").withColumn("ctx", F.substr("g", F.lit(1), F.lit(order - 1)))
        seen, unseen = self.seen.select(F.col("s").alias("g"), F.col("llr").cast("double").alias("own")).hint("merge"), self.unseen.select(F.col("s").alias("ctx"), F.col("llr").cast("double").alias("rest")).hint("merge")
        ratio = places.join(seen, "g", "left").join(unseen, "ctx", "left").groupBy("word").agg(F.sum(F.coalesce("own", "rest", F.lit(0.0))).alias("llr"))
        return words.join(ratio.hint("merge"), "word").groupBy("_t1", "_t2").agg(F.collect_list(F.struct("llr", "n")).alias("ws"))

    def score(self, docs: DataFrame) -> DataFrame:
        """docs (with text) and the column score."""
        if self.weights is None:
            return docs.withColumn("score", F.lit(0.0))
        return self._mapped(docs, [c for c in docs.columns if c != "score"], self._curve(), ["score"])


def op5(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = ToxicityModel(docs, labels)
    # the texts stay behind: only the id and the score leave the scoring tasks
    scored = model.score(docs.select("doc_id", "text")).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
