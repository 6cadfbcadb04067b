"""Approximate nearest neighbours by learned partitions.

A sample of the different vectors gives a neighbour graph; it grows with the table, `PER_PART` of them for each part, up to `SAMPLE`. It
is split into parts of about equal size, first by nearness to centres, then by moving vertices to the part that most of their neighbours
are in, as long as the parts stay balanced. A small network with one hidden
layer learns the part from the vector. It assigns every row to its most probable part and routes every query to several; how many is the
smallest number that finds `AIM` of the sample's own neighbours. Within a part, rows are compared in blocks of about `BLOCK` and the
distances that decide are worked out on the original vectors in double precision. Queries whose parts hold fewer than k candidates are
compared with the other parts as well, so they get k rows wherever there are so many.

A part that holds a third of all rows (say, of one vector) is many blocks, each a task's group of its own.

Defined cases: null, empty, all-zero vectors and those with null or non-finite components take no part, nor do vectors of another length
than the most frequent one; rows with a null vec_id take no part; copies of a vector are neighbours like others, ties go to the smaller
vec_id; with fewer than k candidates all are returned; rows that repeat vec_id and vector count once. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

K = 10
#: Different vectors that the index is fitted on, and how many of them a part takes.
LEAST_SAMPLE, SAMPLE, PER_PART = 4000, 32_768, 32
BLOCK = 4096
#: One part for so many rows, as far as the sample gives parts; centres that a vertex can choose from.
PART_ROWS, LEAST_PARTS, CHOICE = 4096, 4, 16
AIM = 0.97
HIDDEN = 64


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    v = F.col(column).cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select("vec_id", v.alias("v"))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of each row's k nearest other rows."""
    sq = (x * x).sum(1)
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 500):
        d = sq[a : a + 500, None] + sq - 2 * x[a : a + 500] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 500] = np.argpartition(d, out.shape[1] - 1, 1)[:, : out.shape[1]] if out.shape[1] else out[a : a + 500]
    return out


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centres, the nearest first, and their squared distances."""
    at, far = [], []
    for a in range(0, len(x), 2000):
        d = (x[a : a + 2000] ** 2).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x[a : a + 2000] @ centres.T
        best = np.argpartition(d, CHOICE - 1, 1)[:, :CHOICE] if len(centres) > CHOICE else np.tile(np.arange(len(centres)), (len(d), 1))
        d = np.take_along_axis(d, best, 1)
        order = np.argsort(d, 1, kind="stable")
        at.append(np.take_along_axis(best, order, 1))
        far.append(np.take_along_axis(d, order, 1))
    return np.concatenate(at), np.concatenate(far)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.15, rounds: int = 10) -> np.ndarray:
    """A part of each vertex, with at most slack times the mean in any."""
    centres = x[rng.choice(len(x), parts, replace=False)]
    cap = int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds):
        best, d = nearest_centres(x, centres)
        part, room = np.full(len(x), -1), np.full(parts, cap)
        # those with the most to lose choose first
        for i in np.argsort(d[:, 0] - d[:, min(1, d.shape[1] - 1)]):
            p = next((p for p in best[i] if room[p]), -1)
            if p < 0:  # all near centres are full
                open_ = np.flatnonzero(room)
                p = open_[((centres[open_] - x[i]) ** 2).sum(1).argmin()]
            part[i], room[p] = p, room[p] - 1
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(parts)])
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            found, votes = np.unique(part[near[i]], return_counts=True)
            if not len(found):
                continue
            p, most = found[votes.argmax()], votes.max()
            if most > (votes[found == part[i]].sum()) and sizes[p] < cap:
                sizes[part[i]] -= 1
                sizes[p] += 1
                part[i] = p
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer: probabilities of the parts from a vector."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, epochs: int = 40, batch: int = 100) -> None:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-9
        z, n = (x - self.mean) / self.sd, x.shape[1]
        w = [rng.standard_normal((n, HIDDEN)) / np.sqrt(n), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for a in range(0, len(z), batch):
                at = order[a : a + batch]
                h = np.maximum(z[at] @ w[0] + w[1], 0)
                p = self._softmax(h @ w[2] + w[3])
                p[np.arange(len(at)), part[at]] -= 1
                p /= len(at)
                back = (p @ w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((z[at].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum((x - self.mean) / self.sd @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


class LearnedPartitions:
    """router and probes, fitted on a sample of different vectors; with few of them there is one part."""

    def __init__(self, rows: DataFrame, total: int, k: int = K, aim: float = AIM, part_rows: int = PART_ROWS, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        parts = max(LEAST_PARTS, total // part_rows)
        # copies count once, so a sample can't consist of them
        different = rows.groupBy(F.xxhash64("v").alias("h")).agg(F.min_by("v", "vec_id").alias("v"))
        taken = different.orderBy("h").limit(min(SAMPLE, max(LEAST_SAMPLE, PER_PART * parts))).select("v").toArrow()["v"].combine_chunks()
        x = taken.flatten().to_numpy().reshape(len(taken), -1) if len(taken) else np.zeros((0, 1))
        self.parts, self.probes, self.router = max(1, min(parts, len(x) // PER_PART)), 1, None
        if self.parts == 1:
            return
        near = neighbours(x, k)
        self.router = Router(x, balanced_parts(x, near, self.parts, rng), self.parts, rng)
        p = self.router(x)
        own, ranked = p.argmax(1), np.argsort(-p, 1, kind="stable")
        rank_of = np.argsort(ranked, 1)
        needed = np.take_along_axis(rank_of, own[near], 1) + 1  # the rank of the part that holds each neighbour
        self.probes = next(m for m in range(1, self.parts + 1) if (needed <= m).mean() >= aim)

    def ranked(self, x: np.ndarray, most: int) -> np.ndarray:
        return np.argsort(-self.router(x), 1, kind="stable")[:, :most] if self.router else np.zeros((len(x), 1), np.int64)


def nearest(q: np.ndarray, own: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the queries, ids and exact distances of the k nearest rows of c other than a query's own, ties to the smaller id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    square, centre = (c * c).sum(1), (q * q).sum(1)
    for a in range(0, len(q), step := max(1, 4_000_000 // max(1, len(c)))):
        part = slice(a, a + step)
        # by products first; what is near enough within their rounding is worked out exactly
        rough = centre[part, None] + square - 2 * q[part] @ c.T
        rough[own[part][:, None] == ids] = np.inf
        least = np.partition(rough, k - 1, 1)[:, k - 1 : k] if rough.shape[1] > k else np.full((len(rough), 1), np.inf)
        error = 1e-12 * q.shape[1] * (centre[part, None] + square.max(initial=0)) + 1e-300
        i, j = np.nonzero((rough <= least + error) & np.isfinite(rough))
        d = np.sqrt(((c[j] - q[part][i]) ** 2).sum(1))
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[place < k] + a, ids[j[place < k]], d[place < k]))
    return tuple(np.concatenate([o[n] for o in out]) if out else np.zeros(0) for n in range(3))


def compared(asked: DataFrame, placed: DataFrame, parts: int, k: int) -> DataFrame:
    """query_id, vec_id and score of the k nearest within each block, for queries asked (vec_id, v, part)."""
    # a row a part
    held = {r["part"]: -(-r["count"] // BLOCK) for r in placed.groupBy("part").count().collect()}
    sent = {r["part"]: -(-r["count"] // BLOCK) for r in asked.groupBy("part").count().collect()}
    sizes = asked.sparkSession.createDataFrame([(p, held.get(p, 1), sent.get(p, 1)) for p in range(parts)], "part int, held int, sent int")
    every_block = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    own_block = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of).cast("long")).cast("int")
    with_sizes = lambda rows: rows.join(F.broadcast(sizes), "part")
    there = with_sizes(placed.select("vec_id", "v", "part")).where(F.col("part").isin(sorted(sent))).select(F.col("vec_id").alias("c_id"), F.col("v").alias("c"), F.col("part").alias("part"), own_block("held").alias("cb"), every_block("sent").alias("qb"))
    queries = with_sizes(asked).select("vec_id", "v", "part", own_block("sent").alias("qb"), every_block("held").alias("cb"))

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if q.num_rows and c.num_rows:
            vectors = lambda t, name: t[name].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            own = q["vec_id"].to_numpy()
            i, ids, d = nearest(vectors(q, "v"), own, vectors(c, "c"), c["c_id"].to_numpy(), k)
            found = [own[i.astype(np.int64)], ids.astype(np.int64), d]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    key = ["part", "cb", "qb"]
    return queries.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, k: int = K, every: int = 100, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest rows found."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = materialise(usable(vectors).distinct(), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    dims, total = (lengths[0]["n"], lengths[0]["rows"]) if lengths else (0, 0)
    rows = rows.where(F.size("v") == dims)
    index = LearnedPartitions(rows, total, k, part_rows=part_rows)
    model = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").to_numpy()
            x = batch.column("v").flatten().to_numpy().reshape(len(ids), -1)
            ranked = model.value.ranked(x, model.value.probes)
            probes = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * ranked.shape[1]), pa.array(ranked.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(ranked[:, 0].astype(np.int32)), probes], names=["vec_id", "v", "part", "probes"])

    placed = materialise(rows.mapInArrow(assign, "vec_id long, v array<double>, part int, probes array<int>"), "placed")
    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # a row of an id that stands in several rows counts once, by its nearest vector
    top = lambda found: found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = materialise(top(compared(asked.select("vec_id", "v", F.explode("probes").alias("part")), placed, index.parts, k)), "found")
    if index.probes < index.parts:
        enough = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
        short = asked.join(enough, "vec_id", "left_anti")
        if short.limit(1).count():
            others = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(index.parts - 1)), "probes")).alias("part")
            more = compared(short.select("vec_id", "v", others), placed, index.parts, k)
            found = top(found.select("query_id", "vec_id", "score").unionByName(more))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


op8 = search
