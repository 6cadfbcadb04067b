"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is the weighted set of its word shingles (five words; a shorter text is one shingle), weighed by count times inverse document
frequency. Document frequencies are exact counts over all documents for every shingle that at least one document in `RAREST` holds; one
that is rarer weighs like one in `RAREST`, at any size of the corpus. There are no more such shingles than `RAREST` times the mean number
of shingles of a document, so their counts can be sent to the workers (and above `MOST` of them the rarest of these count as rare). Each
of `bands * rows` samples picks a shingle by improved consistent weighted sampling, so two documents agree in a sample as often as their
weighted Jaccard similarity says; documents that agree in all samples of a band are candidates.

Texts of equal words are one class from the start, and only its smallest doc_id goes on. Within a band's bucket every member is first
compared with a pivot, the smallest id. That leaves buckets whose members are of several components: there, those outside the bucket's
largest component meet all members of other components, linked ones too, block by block. Members go on whose sketches, a byte of every
sample, agree with one of those about as the similarity asks; their texts are laid out once a block, and compared unless the links found
in the block have joined them already, so a block gives fewer links than it has members. A bucket of one large group costs a comparison
or so a member, and no pair that shares a band and agrees is left out. Links are verified on the whole texts by weighted Jaccard. As the
shingles that a large group of copies shares are frequent for that very reason, and so weigh little, a pair that reaches the similarity by
its plain shingle sets is a link as well. Connected components of the links are the classes, named by their smallest doc_id.

Defined cases: a null or empty text, or one without words, is in a class of its own; a null doc_id gets a null class; rows that share a
doc_id are one document, whose links are those of any of its texts; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MIX as MULTIPLIER
from .common import discard, materialise, release, small_batches, word_hashes

SHINGLE = 5
#: Shingles of one document in so many have exact frequencies; at most so many of them; counters of the first pass; documents at once.
RAREST, MOST, SLOT_BITS, BLOCK_DOCS = 1000, 1 << 22, 20, 4096
BANDS, ROWS = 20, 5
SIMILARITY = 0.8
POOL_BITS = 16
#: Members of a bucket that meet in one block, and how many different shingles they may have together (some megabytes of text).
BLOCK, BLOCK_KINDS = 1024, 400_000
#: Samples agree in the share that the similarity says, give or take a twentieth; this far below it lies none of a million.
MARGIN = 0.18
SALTS = 8
def near(similarity: float) -> Column:
    """Texts whose weights and numbers of shingles both differ by more can't be alike."""
    alike_size = lambda x: F.least(x, f"pivot_{x}") >= similarity * 0.999 * F.greatest(x, f"pivot_{x}")
    return alike_size("weight") | alike_size("kinds")


def agreeing(similarity: float, samples: int):
    """Of a block of members (x or not), the keys and ids of those that agree with one of another label on the other side."""
    least, step = (similarity - MARGIN) * samples, 4_000_000 // samples

    def pick(block: pa.Table) -> pa.Table:
        x = block["x"].to_numpy()
        rep, weight, kinds, label = (block[c].to_numpy() for c in ("rep", "weight", "kinds", "label"))
        alike_size = lambda of, part: np.minimum(of[part][:, None], of[other]) >= similarity * 0.999 * np.maximum(of[part][:, None], of[other])
        sketch = np.concatenate([c.flatten().to_numpy() for c in block["sketch"].chunks]).reshape(-1, samples)
        own, other = np.flatnonzero(x), np.flatnonzero(~x)
        agrees, step_ = np.zeros(len(x), bool), max(1, step // max(1, len(other)))
        for at in range(0, len(own), step_):
            part = own[at : at + step_]
            i, j = np.nonzero((label[part][:, None] != label[other]) & (alike_size(weight, part) | alike_size(kinds, part)))
            same = (sketch[part[i]] == sketch[other[j]]).sum(1, dtype=np.int32) >= least
            agrees[part[i[same]]] = True
            agrees[other[j[same]]] = True
        found = np.unique(rep[agrees])
        return pa.table({"key": np.full(len(found), block["key"][0].as_py(), np.int64), "rep": found})

    return pick


def pivot_columns() -> list[Column]:
    return [F.col("p.rep").alias("pivot"), F.col("p.weight").alias("pivot_weight"), F.col("p.kinds").alias("pivot_kinds")]


def shingle_stream(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles that begin at each word of all texts, the words' own hashes, and where each text's words begin."""
    h, bounds = word_hashes(column)
    out = np.zeros(len(h), np.uint64)
    for k in range(min(size, len(h))):
        part = out[: len(h) - k] if k else out
        part ^= h[k:] + np.uint64(k + 1)
        part *= MULTIPLIER
        part ^= part >> np.uint64(29)
    return out, h, bounds


def shingles(stream: tuple[np.ndarray, np.ndarray, np.ndarray], i: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the i-th text and their counts."""
    out, h, bounds = stream
    a, b = bounds[i], bounds[i + 1]
    if 0 < b - a < size:  # one shingle of fewer words: what follows the text has no part in it
        short = np.zeros(1, np.uint64)
        for k, x in enumerate(h[a:b]):
            short = (short ^ (np.asarray([x]) + np.uint64(k + 1))) * MULTIPLIER
            short ^= short >> np.uint64(29)
        return short, np.ones(1, np.int64)
    return np.unique(out[a : max(a, b - size + 1)], return_counts=True)


class Weights:
    """IDF by shingle hash: log(1 + documents / frequency), the frequency no lower than `least`; keys (sorted) are the ones above that."""

    def __init__(self, n: int, least: float, keys: np.ndarray, df: np.ndarray) -> None:
        self.n, self.keys, self.idf, self.rare = n, keys, np.log1p(n / np.maximum(df, least)).astype(np.float32), np.float32(np.log1p(n / max(least, 1)))
        # most shingles are rare, and this tells it at once
        self.listed = np.zeros(1 << SLOT_BITS, bool)
        self.listed[keys >> np.uint64(64 - SLOT_BITS)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rare)
        maybe = np.flatnonzero(self.listed[h >> np.uint64(64 - SLOT_BITS)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            same = self.keys[at] == h[maybe]
            out[maybe[same]] = self.idf[at[same]]
        return out


def _distinct(docs: DataFrame, size: int, tell, schema: str) -> DataFrame:
    """What tell makes of the number of documents with words and their distinct shingles (one entry a document), block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            stream = shingle_stream(batch.column("text"), size)
            found += [h for i in range(batch.num_rows) if len(h := shingles(stream, i, size)[0])]
            if len(found) >= BLOCK_DOCS:
                yield tell(len(found), np.concatenate(found))
                found.clear()
        if found:
            yield tell(len(found), np.concatenate(found))

    return docs.select("text").mapInArrow(run, schema)


def weights(docs: DataFrame, size: int = SHINGLE, rarest: int = RAREST, most: int = MOST, bits: int = SLOT_BITS) -> Weights:
    """Two passes: counters by slot of the hash tell where frequent shingles can be, and those slots' shingles are counted one by one.

    A block of m documents tells of a slot only what is above m / (2 * rarest), so the counters fall short of the truth by the sum of that,
    half of what makes a shingle frequent, at most; a slot that has a frequent shingle reaches the other half.
    """

    def slots(m: int, h: np.ndarray) -> pa.RecordBatch:
        n = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(n > m / (2 * rarest))
        return pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2].astype(np.int32)), pa.array(np.r_[n[at], m, len(h)].astype(np.int64))], names=["slot", "n"])

    spark = docs.sparkSession
    counted = _distinct(docs, size, slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "slots", (1 << bits) // 8)
    sums = {r["slot"]: r["n"] for r in counted.where("slot < 0").collect()}
    n, total = sums.get(-1, 0), sums.get(-2, 0)
    least = max(n / rarest, total / most)
    got = counted.where((F.col("slot") >= 0) & (F.col("n") >= least - n / (2 * rarest))).select("slot").toArrow()["slot"].to_numpy()  # 2 ** bits at most
    open_ = np.zeros(1 << bits, bool)
    open_[got] = True
    sent = spark.sparkContext.broadcast(np.packbits(open_))

    def counts(m: int, h: np.ndarray) -> pa.RecordBatch:
        wanted = np.unpackbits(sent.value).astype(bool)
        own, k = np.unique(h[wanted[h >> np.uint64(64 - bits)]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(k.astype(np.int64))], names=["h", "n"])

    frequent = _distinct(docs, size, counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.col("n") > 1)).toArrow()  # MOST at most
    discard(counted)
    keys, df = frequent["h"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = np.argsort(keys)
    return Weights(n, least, keys[order], df[order])


class Sampler:
    """Improved consistent weighted sampling with its random variates in a pool that shingle hashes point into."""

    def __init__(self, samples: int, seed: int = 7, bits: int = POOL_BITS) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, 1 << bits).astype(np.float32)
        self.per_r = (1 / self.r).astype(np.float32)
        self.beta = rng.random(1 << bits, np.float32)
        self.log_c = np.log(rng.gamma(2, 1, 1 << bits)).astype(np.float32) - self.r
        self.odd = rng.integers(1, 1 << 62, samples, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = np.uint64(64 - bits)

    def samples(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        log_w = np.log(weight).astype(np.float32)
        out = np.empty(len(self.odd), np.uint64)
        step = max(1, 60_000 // len(h))
        for a in range(0, len(self.odd), step):
            at = ((h[None, :] * self.odd[a : a + step, None]) >> self.shift).astype(np.int32)
            r, beta = self.r[at], self.beta[at]
            t = np.floor(log_w * self.per_r[at] + beta)
            best = (self.log_c[at] - r * (t - beta)).argmin(1)
            out[a : a + step] = h[best] ^ (t[np.arange(len(best)), best].astype(np.int64).astype(np.uint64) * MULTIPLIER)
        return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = samples.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * MULTIPLIER
    for k in range(rows):
        out = (out ^ x[:, k]) * MULTIPLIER
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(docs: DataFrame, idf, bands: int, rows: int, size: int = SHINGLE) -> DataFrame:
    """doc_id, e1, e2 (hash of the word sequence), weight, kinds (number of different shingles), band keys and sketch (a byte a sample)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        sampler, weigh = Sampler(bands * rows), idf.value
        for batch in batches:
            ids, e, keys, total, kinds, sketch = [], [], [], [], [], []
            stream = shingle_stream(batch.column("text"), size)
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                h, n = shingles(stream, i, size)
                if len(h):
                    ids.append(doc)
                    e.append(xxh3_128_intdigest(stream[1][stream[2][i] : stream[2][i + 1]].tobytes()))
                    weight = n * weigh(h)
                    total.append(float(weight.sum(dtype=float)))
                    kinds.append(len(h))
                    own = sampler.samples(h, weight)
                    sketch.append((own * MULTIPLIER >> np.uint64(56)).astype(np.int8))
                    keys.append(band_keys(own, bands, rows))
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            bytes_ = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands * rows), pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int8)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([signed(x >> 64) for x in e], pa.int64()), pa.array([signed(x & (1 << 64) - 1) for x in e], pa.int64()), pa.array(total, pa.float64()), pa.array(kinds, pa.int32()), lists, bytes_], names=["doc_id", "e1", "e2", "weight", "kinds", "keys", "sketch"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(sign, "doc_id long, e1 long, e2 long, weight double, kinds int, keys array<long>, sketch array<tinyint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum(dtype=float)
    either = a[1].sum(dtype=float) + b[1].sum(dtype=float) - both
    return both / either if either else 0.0


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    """Whether the weighted Jaccard similarity, or else that of the plain shingle sets, reaches the threshold."""
    if min(len(a[0]), len(b[0])) < similarity * max(len(a[0]), len(b[0])):  # no plain similarity, and sizes of weights tell the rest
        small, large = sorted((float(a[1].sum()), float(b[1].sum())))
        if small < similarity * large * 0.999:
            return False
    if weighted_jaccard(a, b) >= similarity:
        return True
    return weighted_jaccard((a[0], np.ones(len(a[0]))), (b[0], np.ones(len(b[0])))) >= similarity


def verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float, size: int = SHINGLE) -> DataFrame:
    """Those of the pairs (a, b) whose texts reach the similarity, with it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = idf.value

        def vector(stream: tuple[np.ndarray, np.ndarray, np.ndarray], i: int) -> tuple[np.ndarray, np.ndarray]:
            h, n = shingles(stream, i, size)
            return h, n * weigh(h)

        last, pivot = None, None
        for batch in batches:
            out = []
            one, two = shingle_stream(batch.column("ta"), size), shingle_stream(batch.column("tb"), size)
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                text = (b, two[1][two[2][i] : two[2][i + 1]].tobytes())
                if last != text:
                    last, pivot = text, vector(two, i)
                if alike(vector(one, i), pivot, similarity):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long").distinct()


def linking(idf, similarity: float, size: int = SHINGLE):
    """Of a block of texts (x or not), links (a, b) between the sides that join all that verified() would."""

    def pick(block: pa.Table) -> pa.Table:
        weigh = idf.value
        block = block.sort_by("x").combine_chunks()  # the others first
        stream = shingle_stream(block["text"].combine_chunks(), size)
        found = [shingles(stream, i, size) for i in range(block.num_rows)]
        used = np.flatnonzero([len(h) for h, _ in found])
        x, rep, label = (block[c].to_numpy()[used] for c in ("x", "rep", "label"))
        out, n = [], int((~x).sum())
        if 0 < n < len(x):
            h = np.concatenate([found[i][0] for i in used])
            weight = np.concatenate([found[i][1] for i in used]) * weigh(h)
            sizes = np.array([len(found[i][0]) for i in used])
            first = np.r_[0, np.cumsum(sizes)]
            total = np.add.reduceat(weight, first[:-1], dtype=float)
            h, at = np.unique(h, return_inverse=True)
            row, joined = np.zeros(len(h)), np.unique(label, return_inverse=True)[1]
            either = lambda a, of, both: of[a] + of[:n][left] - both
            for a in range(n, len(x)):
                alike_size = (np.minimum(sizes[:n], sizes[a]) >= similarity * np.maximum(sizes[:n], sizes[a])) | (np.minimum(total[:n], total[a]) >= similarity * 0.999 * np.maximum(total[:n], total[a]))
                left = np.flatnonzero((joined[:n] != joined[a]) & alike_size)
                if not len(left):
                    continue
                own = slice(first[a], first[a + 1])
                row[at[own]] = weight[own]
                starts = np.r_[0, np.cumsum(sizes[left])]
                of = np.arange(starts[-1]) + np.repeat(first[left] - starts[:-1], sizes[left])
                got = row[at[of]]
                both, shared = np.add.reduceat(np.minimum(got, weight[of]), starts[:-1]), np.add.reduceat((got > 0).astype(float), starts[:-1])
                row[at[own]] = 0
                for k in left[(both / either(a, total, both) >= similarity) | (shared / either(a, sizes, shared) >= similarity)]:
                    if joined[k] != joined[a]:
                        out.append(sorted((rep[a], rep[k]), reverse=True))
                        joined[joined == joined[k]] = joined[a]
        return pa.table({c: np.array([pair[k] for pair in out], np.int64) for k, c in enumerate("ab")})

    return pick


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node and label, the smallest node of its component, of every node of the edges (a, b)."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links", rows)
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumn("moved", F.lit(True)), "labels", rows)
    while True:
        own = labels.select("node", "label")
        near = both.join(own.select(F.col("node").alias("b"), F.col("label").alias("other")).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = own.join(near.hint("merge"), "node").select("node", "label", F.least("label", "other").alias("next"))
        # a label's own label is nearer to the end
        jumped = lower.join(own.select(F.col("node").alias("next"), F.col("label").alias("far")).hint("merge"), "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("moved"))
        new = materialise(jumped, "labels", rows)
        discard(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            discard(both)
            return labels


class Links:
    """Verified links, and the components they form as of the last call of join().

    Joins here and in components() merge at any size: a broadcast would pass the driver each time, and there are many of them.
    """

    def __init__(self, texts: DataFrame, idf, similarity: float, size: int, rows: int | None = None) -> None:
        self.texts, self.idf, self.similarity, self.size, self.rows = texts, idf, similarity, size, rows
        self.edges: list[DataFrame] = []
        self.labels = texts.sparkSession.createDataFrame([], "node long, label long")
        self.spent: list[DataFrame] = [texts]

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows with label, that of rep's component."""
        labels = self.labels.select(F.col("node").alias("rep"), "label").hint("merge")
        return rows.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    def compare(self, rows: DataFrame) -> None:
        """Compares rep and pivot of each row; a pair counts once, in however many buckets."""
        pairs = rows.where("rep <> pivot").select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
        self.edges.append(materialise(verified(pairs, self.texts, self.idf, self.similarity, self.size), "edges"))
        del pairs
        release(self.texts.sparkSession)  # the texts that were dealt out for the pairs

    def meet(self, rows: DataFrame, samples: int) -> None:
        """Links between members apart and all others of their buckets; rows are those of apart()."""
        met = dealt(rows).groupBy("key", "i", "j").applyInArrow(agreeing(self.similarity, samples), "key long, rep long")
        met = materialise(met.distinct(), "met", self.rows)
        some = rows.drop("sketch").distinct().join(met.hint("merge"), ["key", "rep"], "left_semi")
        some = some.join(self.texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
        links = dealt(some).groupBy("key", "i", "j").applyInArrow(linking(self.idf, self.similarity, self.size), "a long, b long")
        self.edges.append(materialise(links.distinct(), "edges"))
        self.spent += [met, rows]
        release(self.texts.sparkSession)

    def join(self) -> None:
        labels = components(reduce(DataFrame.union, self.edges), self.rows)
        self.labels = labels.select("node", "label")
        self.spent.append(labels)

    def end(self) -> DataFrame:
        """The last labels, all else deleted."""
        discard(*self.spent[:-1], *self.edges)
        return self.labels


def apart(links: Links, buckets: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of the buckets of several components, with sketch, label, whether they are outside the largest one, and numbers of blocks."""
    rows = links.labelled(buckets.select("key", "rep", "weight", "kinds"))
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("kinds").alias("w")).groupBy("key")
    largest = sizes.agg(F.max_by(F.struct("label", "n", "w"), F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    # two members have been compared, as one of them is the pivot
    largest = largest.where("top.n < n AND n > 2")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_KINDS, F.lit(1))).cast("int")
    of = largest.select("key", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("nx"), blocks(F.col("n"), F.col("w")).alias("ny"))
    return rows.join(of.hint("merge"), "key").join(sketches.hint("merge"), "rep").select("key", "rep", "weight", "kinds", "label", "sketch", "nx", "ny", (F.col("label") != F.col("top")).alias("apart"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows of apart() in blocks (key, i, j): those apart as x beside each block of all members."""
    place = lambda n: F.pmod(F.hash("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.where("apart").withColumns({"x": F.lit(True), "i": place("nx")}).withColumn("j", every("ny"))
    y = rows.withColumns({"x": F.lit(False), "j": place("ny")}).withColumn("i", every("nx"))
    return x.unionByName(y).drop("nx", "ny", "apart")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, rarest: int = RAREST) -> DataFrame:
    """doc_id, class_id and exact_id (the smallest doc_id of equal words) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    weigh = weights(docs, size, rarest)
    idf, n = spark.sparkContext.broadcast(weigh), weigh.n
    signed = materialise(signatures(docs, idf, bands, rows, size), "signatures")
    # copies first: from here on one document stands for all with the same words
    exact = signed.groupBy("e1", "e2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mapped = signed.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(exact, ["e1", "e2", "salt"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    mapped = materialise(mapped.select("doc_id", "rep", "weight", "kinds", *[F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("keys", "sketch")]), "mapped", n)
    discard(signed)
    members = mapped.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "rep", "weight", "kinds").dropDuplicates(["key", "rep"])
    pivots = members.groupBy("key").agg(F.min(F.struct("rep", "weight", "kinds")).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", *pivot_columns())
    buckets = materialise(members.join(pivots, "key"), "buckets", 4 * n)
    involved = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialise(docs.join(involved, "doc_id", "left_semi"), "involved")

    links = Links(texts, idf, similarity, size, n)
    links.compare(buckets.where(near(similarity)))
    links.join()
    sketches = mapped.where("keys IS NOT NULL").select("rep", "sketch").distinct()
    links.meet(materialise(apart(links, buckets, sketches), "apart", n), bands * rows)
    links.join()
    labels = links.end()
    discard(buckets)
    classes = mapped.select("doc_id", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"), F.col("rep").alias("exact_id")).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("exact_id").alias("exact_id"))
    return docs.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("exact_id", "doc_id").alias("exact_id"))


def op4(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without those that have a near duplicate of a smaller doc_id; of rows equal in doc_id and text one stays."""
    lost = near_duplicates(docs, **options).where("class_id <> doc_id").select(F.col("doc_id").alias("_lost")).distinct()
    kept = docs.join(lost, F.col("doc_id") == F.col("_lost"), "left_anti")
    text = F.xxhash64("text").alias("_text")
    again = materialise(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_again"), text).groupBy("_again", "_text").agg(F.count("*").alias("n")).where("n > 1"), "again")
    if not again.limit(1).count():
        return kept
    same = (F.col("doc_id") == F.col("_again")) & (F.xxhash64("text") == F.col("_text"))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
