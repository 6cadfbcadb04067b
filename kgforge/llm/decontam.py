"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of `PASSAGE` words. Words fall into `2 ** bits` dimensions by hash, weighted by inverse document frequency
over all passages; A is the matrix of passages by dimensions. A distributed randomised SVD finds the passages' latent space: every task
multiplies its passages by a Gaussian matrix of rank and `OVERSAMPLE` columns and adds up A' (A G), the sketch of the range after a power
step, a matrix of fixed size; with Q its orthonormal basis, a second pass adds up A' (A Q), which gives the Gram matrix of B = A Q and so
B's small SVD: right singular vectors V and singular values S of A. A text's place is its row of A V / S, its coordinates among the left
singular vectors. Benchmark items, and windows of the documents as long as the items of a length class, are placed there; windows whose
cosine with an item reaches `cosine` are candidates. Of these go on the ones that share enough words with the item to reach `PART`, by
the bits that their words set first and then word by word, and are checked on the words themselves: the longest common subsequence of item and window must cover `WHOLE` of the item, or `PART` of it
with the item's answer (its last sentence) there too, as a subsequence that covers `ANSWER` of it. Windows can be too coarse for short
items, so unchanged copies are also found as consecutive words, by the hash of the item's first `EXACT` words (all of a shorter one) at
every word; items of fewer than `MIN_WORDS` are found in no other way.

Defined cases: null or empty texts and items have no words and match nothing; repeated items match alike; a null doc_id is scored like
any, and clean() judges every row by its own text; empty tables give empty results or no matches. Other columns are not looked at. All
items are searched in one pass as long as their texts take up to `BLOCK_BYTES`, which bounds what is sent to the workers; there is a
further pass for each further block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX as MULTIPLIER
from .common import materialise, small_batches, word_hashes

BITS = 14
RANK, OVERSAMPLE = 32, 8
PASSAGE = 48
COSINE = 0.55
WHOLE, PART, ANSWER = 0.7, 0.55, 0.9
MIN_WORDS = 8
#: Bytes of benchmark texts that are searched for in one pass: some 100,000 items.
BLOCK_BYTES = 24 << 20
#: Words whose hash finds unchanged copies at every word.
EXACT = 15
#: Windows of a class are as long as its shortest item; the longest is shorter than this times that.
RATIO = 1.4
#: Words that are searched at once, columns of the table that counts shared words, and cosines that are held at once.
PIECE, SHARED, COSINES = 30_000, 2046, 4_000_000
#: Words of 64 bits that tell which words there are.
BIT_WORDS = 4
#: Windows begin at every STEP-th word at most; so many candidates are counted at once.
STEP, AT_ONCE = 5, 1000


def summed(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows that each row of at (numbers of rows) names; by a product, which is faster than adding up."""
    taken = rows.take(at.ravel(), axis=0, mode="clip").reshape(*at.shape, rows.shape[1])
    return (np.ones((1, at.shape[1]), rows.dtype) @ taken)[:, 0]


def padded(starts: np.ndarray, lengths: np.ndarray, width: int, none: int) -> np.ndarray:
    """Consecutive numbers from each start on, as many as lengths says, filled up with none."""
    at = np.arange(width)
    return np.where(at < lengths[:, None], starts[:, None] + at, none)


def multiply_passages(words: np.ndarray, starts: np.ndarray, w: np.ndarray, z: np.ndarray, frequency: np.ndarray) -> None:
    """Of the passages that begin at starts, with T their counts, adds T' (T w) to z, and their numbers by word to frequency.

    The last row of w is one of zeros.
    """
    lengths = np.diff(np.r_[starts, len(words)])
    y = summed(w, np.r_[words, len(w) - 1].take(padded(starts, lengths, lengths.max(), len(words))))
    order = np.argsort(words, kind="stable")
    own, of = words[order], np.repeat(np.arange(len(starts), dtype=np.int32), lengths)[order]
    new = np.r_[True, own[1:] != own[:-1]]
    at = np.flatnonzero(new)
    # a word's places by eights, and then the eights
    eights = -(-np.diff(np.r_[at, len(own)]) // 8)
    first = np.r_[0, np.cumsum(eights)]
    nth = np.arange(first[-1]) - np.repeat(first[:-1], eights)
    begin = np.repeat(at, eights) + 8 * nth
    left = np.minimum(8, np.repeat(np.r_[at[1:], len(own)], eights) - begin)
    y = np.vstack([y, np.zeros((1, y.shape[1]), y.dtype)])
    z[own[at]] += np.add.reduceat(summed(y, np.r_[of, len(starts)].take(padded(begin, left, 8, len(of)))), first[:-1], axis=0)
    new[1:] |= of[1:] != of[:-1]
    frequency += np.bincount(own[new], minlength=len(frequency))


def products(docs: DataFrame, w: np.ndarray, passage: int = PASSAGE) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of passages, that of passages by dimension, and T' (T w) over all passages, with T their counts."""
    spark = docs.sparkSession
    small_batches(spark)
    size, columns = w.shape
    sent = spark.sparkContext.broadcast(w.astype(np.float32))  # 2 ** bits rows

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, df, z, n = np.vstack([sent.value, np.zeros((1, columns), np.float32)]), np.zeros(size, np.int64), np.zeros((size, columns), np.float32), 0
        for batch in batches:
            h, bounds = word_hashes(batch.column("text"))
            words = (h & np.uint64(size - 1)).astype(np.uint16 if size < 1 << 16 else np.int32)
            # passages begin anew with each document
            starts = np.flatnonzero((np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))) % passage == 0)
            n += len(starts)
            for a in range(0, len(starts), 2000):
                s = starts[a : a + 2000]
                end = starts[a + 2000] if a + 2000 < len(starts) else len(words)
                multiply_passages(words[s[0] : end], s - s[0], own, z, df)
        at = np.flatnonzero(df)
        values = pa.FixedSizeListArray.from_arrays(pa.array(z[at].ravel()), columns).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[df[at], n]), pa.concat_arrays([values, pa.array([[0.0] * columns], pa.list_(pa.float32()))])], names=["slot", "n", "z"])

    parts = docs.select("text").mapInArrow(add, "slot int, n long, z array<float>")
    sums = [F.sum(F.get("z", F.lit(k))).alias(f"z{k}") for k in range(columns)]
    got = parts.groupBy("slot").agg(F.sum("n").alias("n"), *sums).toArrow()  # 2 ** bits + 1 rows at most
    sent.unpersist()
    slot = got.column("slot").to_numpy()
    df, z = np.zeros(size, np.int64), np.zeros((size, columns))
    here = slot >= 0
    df[slot[here]] = got.column("n").to_numpy()[here]
    for k in range(columns):
        z[slot[here], k] = got.column(f"z{k}").to_numpy()[here]
    return int(got.column("n").to_numpy()[~here].sum()), df, z


def singular(docs: DataFrame, bits: int = BITS, rank: int = RANK, passage: int = PASSAGE, oversample: int = OVERSAMPLE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """IDFs, the leading right singular vectors of A as columns, and its singular values, by two passes over the documents.

    With D the diagonal of IDFs, A = T D. The first pass doesn't know D yet, and needn't: A' (A W) = D T' (T G) for the random W = D^-1 G.
    """
    columns = min(rank + oversample, 1 << bits)
    g = np.random.default_rng(seed).standard_normal((1 << bits, columns))
    n, df, z = products(docs, g, passage)
    idf = np.log((n + 1) / (df + 1)) + 0.05
    q, _ = np.linalg.qr(idf[:, None] * z)
    gram = q.T @ (idf[:, None] * products(docs, idf[:, None] * q, passage)[2])  # (A Q)' (A Q)
    squares, u = np.linalg.eigh((gram + gram.T) / 2)
    lead = np.argsort(-squares)[:rank]
    return idf, q @ u[:, lead], np.sqrt(np.maximum(squares[lead], 0))


def latent_space(docs: DataFrame, bits: int = BITS, rank: int = RANK, passage: int = PASSAGE) -> np.ndarray:
    """One row a dimension, IDF times V / S, so that a text's place is the sum over its words; and a row of zeros."""
    idf, v, s = singular(docs, bits, rank, passage)
    kept = s > 1e-6 * s.max(initial=0)
    space = idf[:, None] * v[:, kept] / s[kept] * s.max(initial=0) if kept.any() else np.zeros((1 << bits, 1))
    return np.vstack([space, np.zeros((1, space.shape[1]))]).astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, in bits of a whole number."""
    at: dict[int, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := at.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def words_of(texts: list[str | None]) -> list[list[int]]:
    h, bounds = word_hashes(pa.array(texts, pa.string()))
    return [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def answer_of(text: str) -> list[int]:
    """The words of the last sentence that has three or more, else of the whole."""
    sentences = words_of(re.split(r"[.!?\n]+", text))
    return next((s for s in reversed(sentences) if len(s) >= 3), [w for s in sentences for w in s])


def within(item: list[int], answer: list[int], window: list[int]) -> bool:
    there = set(window)
    if sum(w in there for w in item) < PART * len(item):
        return False
    n = lcs(item, window) / len(item)
    return n >= WHOLE or n >= PART and lcs(answer, window) >= ANSWER * len(answer)


def runs(h: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each size up to the longest: hashes of so many consecutive words from each word on."""
    out = np.zeros(len(h), np.uint64)
    for k in range(min(longest, len(h))):
        out = (out[: len(h) - k] ^ (h[k:] + np.uint64(k + 1))) * MULTIPLIER
        out ^= out >> np.uint64(29)
        yield k + 1, out


def bits_of(words: np.ndarray) -> np.ndarray:
    """A row of bits for each word, with one of them set."""
    at = words % (64 * BIT_WORDS)
    out = np.zeros((len(words), BIT_WORDS), np.uint64)
    out[np.arange(len(words)), at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    return out


BITS_BY_SLOT = np.vstack([bits_of(np.arange(64 * BIT_WORDS)), np.zeros((1, BIT_WORDS), np.uint64)])


class Ranges:
    """The bits that are set in any of so many consecutive blocks."""

    def __init__(self, blocks: np.ndarray) -> None:
        self.levels = [blocks]

    def __call__(self, size: int) -> np.ndarray:
        """Of the blocks from each one on that has so many."""
        k = size.bit_length() - 1
        while len(self.levels) <= k:
            below, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(below[: max(0, len(below) - half)] | below[half:])
        level = self.levels[k]
        n, shift = max(0, len(self.levels[0]) - size + 1), size - (1 << k)
        return level[:n] | level[shift : shift + n]


class Items:
    """Benchmark items by length class: ids, words, answers, and places in the latent space; all by the hash of how they begin as well."""

    def __init__(self, rows: list[tuple[int, str]], space: np.ndarray) -> None:
        mask = np.uint64(len(space) - 2)
        by: dict[int, list] = {}
        begin: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for (item_id, text), words in zip(rows, words_of([t for _, t in rows]), strict=True):
            if len(words) >= MIN_WORDS:
                length = int(np.ceil(RATIO ** np.floor(np.log(len(words)) / np.log(RATIO) + 1e-9)))
                by.setdefault(min(length, len(words)), []).append((item_id, words, answer_of(text)))
            if words:
                whole = np.array(words, np.uint64)
                *_, (size, own) = runs(whole[:EXACT], EXACT)
                begin.setdefault(size, {}).setdefault(int(own[0]), []).append((item_id, whole))
        #: by number of words: sorted hashes and the items of each
        self.exact = {size: (np.array(sorted(of), np.uint64), [of[x] for x in sorted(of)]) for size, of in begin.items()}
        self.classes = []
        for length, items in sorted(by.items()):
            hashed = [(np.array(words, np.uint64) & mask).astype(np.int64) for _, words, _ in items]
            place = np.stack([space[h].sum(0) for h in hashed])
            longest = max(map(len, hashed))
            # a place of its own (SHARED) fills up the shorter ones
            shared = np.stack([np.r_[h % SHARED, np.full(longest - len(h), SHARED)] for h in hashed]).astype(np.int32)
            bits = np.stack([np.bitwise_or.reduce(bits_of(h), axis=0) for h in hashed])
            self.classes.append((length // STEP * STEP, longest, bits, items, (place / (np.linalg.norm(place, axis=1, keepdims=True) + 1e-9)).astype(np.float32), shared, PART * np.array([len(h) for h in hashed])))
        self.longest = max([c[1] for c in self.classes], default=1)


def candidates(words: np.ndarray, space: np.ndarray, items: Items, cosine: float) -> Iterator[tuple[tuple, int, int]]:
    """(item, first and end word of the region to check) for the windows that are near enough and share enough words."""
    # sums over STEP words each, as all windows begin and end at multiples of it
    n = len(space) - 1  # the row of zeros
    by_step = np.r_[words, np.full(-len(words) % STEP, n, words.dtype)].reshape(-1, STEP)
    blocks = summed(space, by_step)
    run = np.zeros((len(blocks) + 1, space.shape[1]), np.float32)
    np.cumsum(blocks, axis=0, out=run[1:])
    # beyond the ends stands what no item has
    pad = (items.longest + items.longest // 2) // STEP * STEP + 6 * STEP
    spots = np.full(len(words) + 2 * pad, SHARED + 1, np.int32)
    spots[pad:-pad] = words % SHARED
    bits = np.zeros((len(blocks) + 2 * pad // STEP, BIT_WORDS), np.uint64)
    bits[pad // STEP : pad // STEP + len(blocks)] = np.bitwise_or.reduce(BITS_BY_SLOT.take(np.where(by_step < n, by_step % (64 * BIT_WORDS), 64 * BIT_WORDS), axis=0), axis=1)
    within_reach = Ranges(bits)
    table = np.zeros((AT_ONCE, SHARED + 2), bool)
    row = np.arange(AT_ONCE, dtype=np.int32)[:, None] * (SHARED + 2)
    for length, longest, own_bits, own, place, shared, least in items.classes:
        step = max(1, length // 3 // STEP)
        starts = np.arange(0, max(1, len(blocks) - length // STEP + step), step)
        before, reach = step * STEP + length // 8, longest + 2 * step * STEP + length // 4
        view = np.lib.stride_tricks.sliding_window_view(spots, reach)
        # the blocks that the region to check lies in
        lead = -(-before // STEP)
        there = ~within_reach(-(-(lead * STEP - before + reach) // STEP)).take(starts + pad // STEP - lead, axis=0)
        most = np.array([len(x[1]) for x in own]) - least
        for first in range(0, len(starts), max(1, COSINES // len(own))):
            part = starts[first : first + max(1, COSINES // len(own))]
            at = run.take(np.minimum(part + length // STEP, len(blocks)), axis=0) - run.take(part, axis=0)
            at /= np.sqrt(np.einsum("ij,ij->i", at, at))[:, None] + 1e-9
            w, k = np.divmod(np.flatnonzero(at @ place.T >= cosine), len(own))
            # each bit of an item that the region lacks is a word at least that it lacks
            lacked = np.bitwise_count(there.take(first + w, axis=0) & own_bits.take(k, axis=0))
            few = sum(lacked[:, n].astype(np.int16) for n in range(BIT_WORDS)) <= most.take(k)
            w, k = w[few], k[few]
            begin = part[w] * STEP - before
            for a in range(0, len(w), AT_ONCE):
                s, y = begin[a : a + AT_ONCE], k[a : a + AT_ONCE]
                flat, here = table.ravel(), (view[s + pad] + row[: len(s)]).ravel()
                flat[here] = True
                enough = flat.take(shared.take(y, axis=0) + row[: len(s)]).sum(1) >= least[y]
                flat[here] = False
                for f, item in zip(s[enough].tolist(), y[enough].tolist(), strict=True):
                    yield own[item], max(0, f), f + reach


def copies(h: np.ndarray, bounds: np.ndarray, items: Items) -> Iterator[tuple[int, int]]:
    """(text, item id) of the items that stand unchanged within a text."""
    for size, own in runs(h, max(items.exact, default=0)):
        if size in items.exact:
            known, of = items.exact[size]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            begin = np.flatnonzero(known[at] == own)
            doc = np.searchsorted(bounds, begin, "right") - 1
            for first, d, k in zip(begin.tolist(), doc.tolist(), at[begin].tolist(), strict=True):
                for item_id, whole in of[k]:
                    if first + len(whole) <= bounds[d + 1] and np.array_equal(h[first : first + len(whole)], whole):
                        yield d, item_id


def found_in(texts: pa.Array, space: np.ndarray, items: Items, cosine: float) -> dict[int, set[int]]:
    """The ids of the items that each text contains, by the text's number."""
    h, bounds = word_hashes(texts)
    words = (h & np.uint64(len(space) - 2)).astype(np.int32)
    found: dict[int, set[int]] = {}
    # pieces overlap by more than an item; they run over the ends of documents, but no check does
    for a in range(0, len(words) if items.classes else 0, PIECE):
        own = words[a : a + PIECE + 3 * items.longest]
        for (item_id, parts, answer), first, end in candidates(own, space, items, cosine):
            first, end = a + first, min(a + end, len(words))
            doc = int(np.searchsorted(bounds, first, "right")) - 1
            while doc < len(bounds) - 1 and bounds[doc] < end:
                if item_id not in found.get(doc, ()) and within(parts, answer, h[max(first, bounds[doc]) : min(end, bounds[doc + 1])].tolist()):
                    found.setdefault(doc, set()).add(item_id)
                doc += 1
    for doc, item_id in copies(h, bounds, items):
        found.setdefault(doc, set()).add(item_id)
    return found


def search(docs: DataFrame, model, cosine: float) -> DataFrame:
    """doc_id and found (item ids) of the documents that contain any."""
    small_batches(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = found_in(batch.column("text"), *model.value, cosine)
            at = sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([sorted(found[d]) for d in at], pa.list_(pa.int64()))], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, found array<long>")


def models(docs: DataFrame, benchmark: DataFrame, bits: int = BITS, rank: int = RANK, block_bytes: int = BLOCK_BYTES) -> Iterator:
    """A broadcast (space, items) for each block of the benchmark's items; none if there are no items."""
    spark, space, block, size = docs.sparkSession, None, [], 0
    rows = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        if space is None:
            space = latent_space(docs, bits, rank)
        block.append((item_id, text))
        size += len(text.encode())
        if size >= block_bytes:
            yield spark.sparkContext.broadcast((space, Items(block, space)))
            block, size = [], 0
    if block:
        yield spark.sparkContext.broadcast((space, Items(block, space)))


def matches(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, bits: int = BITS, rank: int = RANK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and the sorted item ids that its text contains, for documents that contain any."""
    found = [materialise(search(docs, model, cosine), "found") for model in models(docs, benchmark, bits, rank, block_bytes)]
    if not found:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array().cast("array<long>").alias("items")).limit(0)
    return reduce(DataFrame.union, found).select("doc_id", F.explode("found").alias("item")).groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("items"))


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).select("doc_id", "items", F.size("items").cast("long").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, bits: int = BITS, rank: int = RANK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose texts contain no benchmark item; rows are judged where they lie, so none is shuffled."""
    small_batches(docs.sparkSession)
    out = docs
    for k, model in enumerate(models(docs, benchmark, bits, rank, block_bytes)):

        def keep(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[list(found_in(batch.column("text"), *model.value, cosine))] = False
                yield batch.filter(pa.array(stays))

        # a model a pass
        out = (out if k == 0 else materialise(out, "clean")).mapInArrow(keep, docs.schema)
    return out
