"""Mixing sources to target weights by Pfair scheduling.

Time is counted in slots of one block each. A source of weight w must have had its block j in the window from floor(j / w) to
ceil((j + 1) / w); earliest deadline first over the released blocks keeps every source within one block of w * t at every slot t.
Weights are exact fractions of the targets, and all blocks of all sources are scheduled like this, one by one, on the driver, however many
there are. Its time grows with the number of blocks (rows / `block`), as a phase costs no more than the blocks that it schedules; its memory
grows with the number of sources, as the plan is written piece by piece and joined. When a source runs out, the others go on with their
weights scaled to add up again; each of those phases, at most one a source, is a schedule of its own.

With a `period` weights are whole numbers that add up to it instead, so the schedule repeats after so many slots, one period is worked out
and every block's slot follows from its number by arithmetic; weights are then only as near to the targets as the period allows. Each
phase then takes time for all sources that are left.

A row's number within its source comes from counting in buckets by hash: rows of a bucket are numbered by a window, and buckets get
their first number from a running sum over bucket counts, in two levels. No window holds more than a bucket.

Defined cases: a null source is the source ''; a source without a target weight, or with one of 0 or less, gets the smallest weight; rows
that repeat get numbers of their own; an empty table gives an empty result. All rows are returned, each once. Other columns pass
through; the added ones replace any of the same names.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

#: Rows of a periodic schedule, one a source and phase, that are broadcast; more are joined like other tables, for the same result.
MAX_SOURCES = 10_000
BUCKET_ROWS = 2048
#: Blocks of the plan that the driver holds at once.
PIECE = 1_000_000
ADDED = ("slot", "phase", "position")


def quantise(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole weights of at least 1 that add up to period, by largest remainder."""
    if len(weights) > period:
        raise ValueError("more sources than slots in a period")
    least = min([w for w in weights.values() if w > 0], default=1)
    weights = {s: w if w > 0 else least for s, w in weights.items()}
    total, room = sum(weights.values()), period - len(weights)
    share = {s: Fraction(w) / Fraction(total) * room for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of every source's blocks over one period: earliest deadline first, released blocks only."""
    period = sum(weights.values())
    deadline = lambda s, j: -(-(j + 1) * period // weights[s])
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting, ready = [(0, s) for s in sorted(weights)], []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            # of equal deadlines the one whose next window overlaps goes first, then the heavier
            heapq.heappush(ready, (deadline(s, len(slots[s])), (len(slots[s]) + 1) * period % weights[s] == 0, -weights[s], s))
        s = heapq.heappop(ready)[-1]
        slots[s].append(t)
        if (j := len(slots[s])) < weights[s]:
            heapq.heappush(waiting, (j * period // weights[s], s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """One entry a phase and source that has blocks in it: first block, its number of blocks, whole weight, slots within a period
    (as many as it has blocks at most), first slot of the phase."""
    left, begin, out = {s: n for s, n in blocks.items() if n}, 0, []
    done = dict.fromkeys(blocks, 0)
    k = 0
    while left:
        whole = quantise({s: weights.get(s, 0) for s in left}, period)
        slots = schedule(whole)
        at = lambda s, j: j // whole[s] * period + slots[s][j % whole[s]]  # noqa: E731, B023
        end = min(at(s, n - 1) for s, n in left.items()) + 1
        for s in sorted(left):
            n = end // period * whole[s] + sum(x < end % period for x in slots[s])
            if n:
                out.append({"phase": k, "source": s, "first_block": done[s], "n_blocks": n, "weight": whole[s], "slots": slots[s][:n], "begin": begin})
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        begin += end
        k += 1
    return out


def turns(blocks: Sequence[int], weights: Iterable[float]) -> Iterator[tuple[int, int, int]]:
    """Source, number of the block within it and phase, slot by slot, for all blocks: earliest deadline first by the exact weights.

    Sources are numbers, smaller ones first in ties, and have a block at least. Of equal deadlines the one whose next window overlaps goes
    first, then the heavier. Weights of 0 or less are the smallest other one of the sources that are left.

    All first blocks of a phase are released at its start, and by these rules they go by weight. So sources that have had no block in a
    phase stay sorted from one phase to the next, and only those that have had one are put back.
    """
    # sources share what is large: each different weight is kept once, as a whole number
    numbers: dict[float, int] = {}
    kind = array("q", (numbers.setdefault(w, len(numbers)) for w in weights))
    shares = [Fraction(w) if w > 0 else Fraction(0) for w in numbers]
    scale = math.lcm(*{w.denominator for w in shares})
    whole = [int(w * scale) for w in shares]
    done = array("q", bytes(8 * len(blocks)))

    heavy = array("q", sorted((s for s in range(len(blocks)) if whole[kind[s]]), key=lambda s: -whole[kind[s]]))
    light = array("q", [s for s in range(len(blocks)) if not whole[kind[s]]])
    # of each, places of those that were put back; the others follow from the next place on
    heavy_back, heavy_next, light_back, light_next = [], 0, [], 0
    left, weighed, lowest, phase = len(light), sum(whole[kind[s]] for s in heavy), len(heavy) - 1, 0
    while weighed or left:
        while lowest >= 0 and done[heavy[lowest]] == blocks[heavy[lowest]]:
            lowest -= 1
        least = whole[kind[heavy[lowest]]] if lowest >= 0 else 1
        total, t, own, waiting, ready = weighed + left * least, 0, {}, [], []

        def key(s: int, j: int) -> tuple[int, bool, int, int]:
            w = whole[kind[s]] or least  # noqa: B023
            deadline, over = divmod((j + 1) * total, w)  # noqa: B023
            return deadline + (over > 0), over == 0, -w, s

        def first() -> tuple[tuple[int, bool, int, int], bool, int] | None:
            """Of the sources without a block in this phase the one that goes first: its key, whether it has a weight, its place."""
            at = heavy_back[0] if heavy_back else heavy_next
            low = light_back[0] if light_back else light_next
            found = []
            if at < len(heavy):
                found.append((key(heavy[at], 0), True, at))
            if low < len(light):
                found.append((key(light[low], 0), False, low))
            return min(found, default=None)

        places, fresh = {}, first()
        while True:
            while waiting and waiting[0][0] <= t:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(ready, key(s, own[s]))
            if fresh and (not ready or fresh[0] < ready[0]):
                (*_, s), weighty, place = fresh
                places[s] = place
                back = heavy_back if weighty else light_back
                if back:
                    heapq.heappop(back)
                elif weighty:
                    heavy_next += 1
                else:
                    light_next += 1
                fresh = first()
            else:
                s = heapq.heappop(ready)[-1]
            yield s, done[s], phase
            own[s] = own.get(s, 0) + 1
            done[s] += 1
            t += 1
            if done[s] == blocks[s]:
                break
            heapq.heappush(waiting, (own[s] * total // (whole[kind[s]] or least), s))
        if whole[kind[s]]:
            weighed -= whole[kind[s]]
        else:
            left -= 1
        del places[s]
        for other, place in places.items():
            heapq.heappush(heavy_back if whole[kind[other]] else light_back, place)
        phase += 1


def exact(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """turns() of named sources; those that have no blocks play no part."""
    names = sorted(s for s, n in blocks.items() if n)
    for k, b, phase in turns([blocks[s] for s in names], [weights.get(s, 0) for s in names]):
        yield names[k], b, phase


def exact_plan(spark: SparkSession, names: pa.ChunkedArray, sizes: np.ndarray, weights: Iterable[float], block: int) -> DataFrame:
    """_s, _b (a block's number within its source), _slot, _phase and _start, the position of its first row, of all blocks.

    names: the sources in order; sizes: their rows.
    """
    path, start, slot = new_path(spark, "plan"), 0, 0
    schema = "_s string, _b long, _slot long, _phase int, _start long"
    columns = [array("q") for _ in range(4)]

    def write() -> None:
        s, b, phase, starts = (np.array(c) for c in columns)
        table = pa.table([names.take(pa.array(s)).cast(pa.string()), b, np.arange(slot - len(s), slot), phase.astype("int32"), starts], names=["_s", "_b", "_slot", "_phase", "_start"])
        spark.createDataFrame(table, schema).write.mode("append").parquet(path)
        for c in columns:
            del c[:]

    rows = array("q", sizes.tobytes())
    for s, b, phase in turns(array("q", (-(-sizes // block)).tobytes()), weights):
        for c, x in zip(columns, (s, b, phase, start), strict=True):
            c.append(x)
        start += min(block, rows[s] - b * block)
        slot += 1
        if len(columns[0]) == PIECE:
            write()
    write()
    return spark.read.schema(schema).parquet(path)


def numbered(docs: DataFrame, total: int, key: str = "doc_id") -> DataFrame:
    """docs with _rn, the row's number within its _src from 0, in the order of a hash of the key."""
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = docs.withColumns({"_h": F.xxhash64(key, *[c for c in ("text",) if c in docs.columns])}).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    counts = rows.groupBy("_src", "_b").agg(F.count("*").alias("n")).withColumn("_g", F.floor(F.col("_b") / BUCKET_ROWS))
    groups = counts.groupBy("_src", "_g").agg(F.sum("n").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.withColumn("in_group", before("_src", "_g", "_b")).join(groups.select("_src", "_g", before("_src", "_g").alias("group_first")), ["_src", "_g"]).select("_src", "_b", (F.col("in_group") + F.col("group_first")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_src", "_b").orderBy("_h", key)) - 1
    return rows.withColumn("_own", own).join(first, ["_src", "_b"]).withColumn("_rn", F.col("_first") + F.col("_own")).drop("_h", "_b", "_own", "_first")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 16, period: int | None = None, temper: float = 0.5) -> DataFrame:
    """docs with slot, phase and position, a dense number that orders the mixture.

    weights: target weight of each source; by default the number of its rows to the power temper.
    period: slots after which the schedule repeats, with weights rounded to it; by default weights are exact.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED).withColumn("_src", F.coalesce("source", F.lit("")))
    counts = docs.groupBy("_src").agg(F.count("*").alias("n")).toArrow()
    counts = counts.take(pc.sort_indices(counts["_src"]))
    names, n = counts["_src"], counts["n"].to_numpy()
    placed = numbered(docs, int(n.sum())).withColumn("_block", F.floor(F.col("_rn") / block))
    if period is None:
        own = (x**temper for x in map(int, n)) if weights is None else (weights.get(s.as_py(), 0) for s in names)
        plan = exact_plan(spark, names, n, own, block)
        joined = placed.join(plan, (F.col("_src") == F.col("_s")) & (F.col("_block") == F.col("_b")))
        return joined.withColumns({
            "slot": F.col("_slot"), "phase": F.col("_phase"), "position": F.col("_start") + F.pmod("_rn", F.lit(block)),
        }).drop("_src", "_s", "_b", "_rn", "_block", "_slot", "_phase", "_start")
    per = dict(zip(names.to_pylist(), n.tolist(), strict=True))
    if weights is None:
        weights = {s: x**temper for s, x in per.items()}
    plan, rows, sizes = phases({s: -(-n // block) for s, n in per.items()}, weights, period), 0, {}
    for x in plan:  # only the last block of a source is short, and a phase ends with it
        sizes[x["phase"]] = sizes.get(x["phase"], 0) + min(per[x["source"]], (x["first_block"] + x["n_blocks"]) * block) - min(per[x["source"]], x["first_block"] * block)
    starts = {}
    for k in sorted(sizes):
        starts[k], rows = rows, rows + sizes[k]
    schema = "_src string, _phase int, _from long, _to long, _w int, _slots array<int>, _begin long, _start long"
    lookup = spark.createDataFrame([(x["source"], x["phase"], x["first_block"], x["first_block"] + x["n_blocks"], x["weight"], x["slots"], x["begin"], starts[x["phase"]]) for x in plan], schema).withColumnRenamed("_src", "_s")
    joined = placed.join(F.broadcast(lookup) if len(plan) <= MAX_SOURCES else lookup, (F.col("_src") == F.col("_s")) & (F.col("_block") >= F.col("_from")) & (F.col("_block") < F.col("_to")))
    j = F.col("_block") - F.col("_from")
    within = F.floor(j / F.col("_w")) * period + F.element_at("_slots", (F.pmod(j, F.col("_w").cast("long")) + 1).cast("int"))
    return joined.withColumns({
        "slot": (F.col("_begin") + within).cast("long"), "phase": F.col("_phase"), "position": (F.col("_start") + within * block + F.pmod("_rn", F.lit(block))).cast("long"),
    }).drop("_src", "_s", "_rn", "_block", "_phase", "_from", "_to", "_w", "_slots", "_begin", "_start")


def op3(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "phase", "slot", "position")
