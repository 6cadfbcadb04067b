"""Quality by co-training: a view of the text's content and one of its metadata teach each other.

The content view is hashed words and token shapes; the metadata view is length, layout, source and language. Both views of every
document are worked out once and kept as a table; a logistic classifier for each view is fitted on labelled rows. In every round each
view scores all unlabelled rows, and the `SURE` texts that it is surest of, in the proportion of the classes, go into the other view's
training. Both views are then calibrated on labelled rows that neither saw, and a second curve on the calibrated log-odds combines them.
The combined score is given to every document.

Labelled rows are a bounded sample by hash of doc_id (`LABELLED`); the rest covers all rows. Rows whose crc32(doc_id as text) mod 4 is 2
never give a label and are never taught with, so they measure what unseen rows get.

Defined cases: a null or empty text has no words, and its metadata say so; null source, lang or n_chars count as '' or as the text's
length; contradicting labels count as low quality; without labels of both classes every score is the share of quality-1 labels (0.5
without any); repeated rows score alike, and equal texts teach once; a null doc_id scores and teaches like any; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, small_batches
from .toxicity import fit_curve

BITS = 13
#: Labelled rows at most; texts that a view teaches the other a round.
LABELLED = 6000
ROUNDS, SURE = 4, 300
#: Of the labelled rows, one in so many calibrates.
CURVE_FOLD = 4
TOKEN = re.compile(r"\S+")
MEMORY = 400_000
META_HASH = 32
META = 11 + 2 * META_HASH


class TokenSlots(dict):
    """Two dimensions of a token: its word and its shape."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > MEMORY:
            self.clear()
        word = token.lower().strip(".,;:!?()\"'")
        shape = ("U" if token.isupper() else "T" if token[:1].isupper() else "l") + "".join(dict.fromkeys(c for c in token if not c.isalnum()))[:3] + str(min(len(token) // 4, 4))
        mask = (1 << BITS - 1) - 1
        self[token] = x = (crc32(word.encode("utf-8", "surrogatepass")) & mask, mask + 1 + (crc32(shape.encode("utf-8", "surrogatepass")) & mask))
        return x


def metadata_view(text: str, tokens: list[str], source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META, np.float32)
    n, m = max(1, len(text)), max(1, len(tokens))
    lines = text.count("\n") + 1
    out[:11] = (
        np.log1p(len(text) if n_chars is None else max(0, n_chars)) / 5, np.log1p(lines) / 3, np.log1p(n / lines) / 4, np.log1p(n / m) / 2, len(set(tokens)) / m, sum(map(str.isupper, tokens)) / m,
        len(tokens[-1:]) and float(tokens[-1][-1] in ".!?"), text.count(".") / m, text.count(",") / m, text.count("|") / m, sum(text.count(c) for c in "*#$%&!") / m,
    )
    out[11 + crc32((source or "").encode("utf-8", "surrogatepass")) % META_HASH] = 1
    out[11 + META_HASH + crc32((lang or "").encode("utf-8", "surrogatepass")) % META_HASH] = 1
    return out


class Logistic:
    """Ridge logistic regression on rows of (dimensions, values), by Adagrad on all rows at once."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, rounds: int = 80, ridge: float = 1e-4, rate: float = 0.5) -> None:
        at, v, starts = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum([0, *(len(r[0]) for r in rows)])
        of = np.repeat(np.arange(len(rows)), np.diff(starts))
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        w, b, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
        for _ in range(rounds):
            run = np.r_[0.0, np.cumsum(v * w[at])]
            p = 1 / (1 + np.exp(-np.clip(run[starts[1:]] - run[starts[:-1]] + b, -30, 30)))
            e = (p - y) * weight
            g = np.bincount(at, v * e[of], size) + ridge * w
            gw += g * g
            gb += e.sum() ** 2
            w -= rate * g / np.sqrt(gw)
            b -= rate * e.sum() / np.sqrt(gb)
        self.w, self.b = w.astype(np.float32), float(b)

    def odds(self, at: np.ndarray, v: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows that begin at starts (one more entry than rows)."""
        run = np.r_[0.0, np.cumsum(v * self.w[at], dtype=float)]
        return run[starts[1:]] - run[starts[:-1]] + self.b


def content_rows(at: pa.ListArray, n: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dimensions and values of all rows, and where each begins; a row's values are logarithms of counts, at length one."""
    flat, starts = at.flatten().to_numpy(), np.r_[0, np.cumsum(at.value_lengths().to_numpy())].astype(np.int64)
    v = np.log1p(n.flatten().to_numpy().astype(np.float64))
    squares = np.r_[0.0, np.cumsum(v * v)]
    v /= np.repeat(np.sqrt(np.maximum(squares[starts[1:]] - squares[starts[:-1]], 0)) + 1e-9, np.diff(starts))
    return flat, v.astype(np.float32), starts


def metadata_rows(meta: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = meta.flatten().to_numpy()
    return np.tile(np.arange(META), len(meta)), flat, np.arange(len(meta) + 1) * META


def view_table(docs: DataFrame) -> DataFrame:
    """doc_id, own (hash of the content view), at and n (dimensions and counts) and meta of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = TokenSlots()
        for batch in batches:
            at, n, own, meta = [], [], [], []
            for text, source, lang, chars in zip(*(batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")), strict=True):
                tokens = TOKEN.findall(text or "")
                a, k = np.unique(np.array([slots[t] for t in tokens], np.int16).ravel(), return_counts=True)
                at.append(a)
                n.append(k.astype(np.int32))
                own.append(xxh64_intdigest(a.tobytes() + k.astype(np.int64).tobytes()) >> 1)
                meta.append(metadata_view(text or "", tokens, source, lang, chars))
            lists = lambda x, kind, none: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(y) for y in x])].astype(np.int32)), pa.array(np.concatenate(x) if x else none, kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.int64()), lists(at, pa.int16(), []), lists(n, pa.int32(), []), lists(meta, pa.float32(), [])], names=["doc_id", "own", "at", "n", "meta"])

    from xxhash import xxh64_intdigest

    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return materialise(docs.mapInArrow(run, "doc_id long, own long, at array<smallint>, n array<int>, meta array<float>"), "views")


class Rows:
    """Some rows of the view table on the driver: content and metadata, each as a list of (dimensions, values)."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        column = lambda c: table[c].chunk(0) if table.num_rows else pa.array([], table.schema.field(c).type)
        cut = lambda at, v, starts: [(at[a:b], v[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.views = cut(*content_rows(column("at"), column("n"))), cut(*metadata_rows(column("meta")))


def odds_of(batch: pa.RecordBatch, content: Logistic, metadata: Logistic) -> tuple[np.ndarray, np.ndarray]:
    return content.odds(*content_rows(batch.column("at"), batch.column("n"))), metadata.odds(*metadata_rows(batch.column("meta")))


class CoTraining:
    """models: the classifiers of content and metadata; curves: of either view and of both. prior where there is nothing to learn from."""

    def __init__(self, views: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: int = SURE, labelled: int = LABELLED) -> None:
        given = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("y")).where(~held_out(F.col("doc_id")))
        ids = given.join(views.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
        # ids has LABELLED rows at most, and a repeated doc_id counts once
        mine = views.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("own", "meta", "at", "n")).alias("x")).orderBy("doc_id").select("y", "x.*").toArrow()
        y, rows = mine["y"].to_numpy(), Rows(mine).views
        fold = np.arange(len(y)) % CURVE_FOLD == 0
        train, curve = np.flatnonzero(~fold), np.flatnonzero(fold)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.curves = None
        if len(set(y[train])) < 2 or len(set(y[curve])) < 2:
            return
        free = views.join(given.select("doc_id").hint("merge"), "doc_id", "left_anti").where(~held_out(F.col("doc_id")))
        free = materialise(free, "free")
        share = y[train].mean()
        #: what each view is taught: rows and pseudo-labels
        taught: tuple = ([], [], [], [])

        def fit(k: int, size: int) -> Logistic:
            return Logistic([*(rows[k][i] for i in train), *taught[2 * k]], np.r_[y[train], taught[2 * k + 1]].astype(float), size)

        known = [set(), set()]
        for k in range(rounds + 1):
            self.models = fit(0, 1 << BITS), fit(1, META)
            if k == rounds:
                break
            surest = self._surest(free, sure, share)
            # content teaches metadata, and the other way round
            picked = {own for own, _, of in surest}
            got = free.where(F.col("own").isin([*picked])).groupBy("own").agg(F.min(F.struct("meta", "at", "n")).alias("x")).orderBy("own").select("own", "x.*").toArrow() if picked else None  # 2 * sure rows at most
            if got is None:
                break
            at, found = {own: i for i, own in enumerate(got["own"].to_pylist())}, Rows(got).views
            for own, label, of in surest:
                to = 1 - of
                if own not in known[to]:
                    known[to].add(own)
                    taught[2 * to].append(found[to][at[own]])
                    taught[2 * to + 1].append(label)
        odds = np.array([[m.odds(*v, np.array([0, len(v[0])]))[0] for m, v in zip(self.models, (rows[0][i], rows[1][i]), strict=True)] for i in curve])
        truth = y[curve].astype(float)
        first = [fit_curve(odds[:, [k]], truth) for k in (0, 1)]
        both = fit_curve(np.column_stack([odds[:, k] * first[k][0] + first[k][1] for k in (0, 1)]), truth)
        self.curves = (*first, both)

    def _surest(self, free: DataFrame, sure: int, share: float) -> list[tuple[int, int, int]]:
        """(own, label, view) of the different texts that each view is surest of among all unlabelled rows."""
        models = free.sparkSession.sparkContext.broadcast(self.models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("own"), *map(pa.array, odds_of(batch, *models.value))], names=["own", "o0", "o1"])

        # equal texts differ in their metadata at most, and count once
        odds = free.mapInArrow(run, "own long, o0 double, o1 double").groupBy("own").agg(F.max("o0").alias("o0"), F.max("o1").alias("o1"))
        odds, low = materialise(odds, "odds"), max(1, round(sure * (1 - share)))
        out = []
        for view in (0, 1):
            least = [r["own"] for r in odds.orderBy(f"o{view}", "own").limit(low).collect()]
            most = [r["own"] for r in odds.orderBy(F.desc(f"o{view}"), "own").limit(max(1, sure - low)).collect()]
            out += [(own, 0, view) for own in least] + [(own, 1, view) for own in most if own not in set(least)]
        return out

    def probabilities(self, batch: pa.RecordBatch) -> np.ndarray:
        """Of both views and of both together, a row each."""
        if not self.curves:
            return np.full((batch.num_rows, 3), self.prior)
        a, b, both = self.curves
        x, y = (o * c[0] + c[1] for o, c in zip(odds_of(batch, *self.models), (a, b), strict=True))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, y, both[0] * x + both[1] * y + both[2]]), -30, 30)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, content_score, metadata_score, score, predicted."""
    views = view_table(docs)
    model = docs.sparkSession.sparkContext.broadcast(CoTraining(views, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.probabilities(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(3))], names=["doc_id", "content_score", "metadata_score", "score"])

    scored = views.select("doc_id", "at", "n", "meta").mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


op7 = score
