"""What the corpus operators share: tables, shared storage, hashing."""

from __future__ import annotations

import ctypes
import gc
import itertools
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgforge.session import ship

#: ASCII white space that the line contracts name: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = getattr(spark, "_kgforge_shared", None) or "file://" + tempfile.mkdtemp(prefix="kgforge-")
        spark._kgforge_shared = base
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/kgforge-{tag}-{uuid.uuid4().hex}"


#: After so many tables, what they were made from is let go.
RELEASE_EVERY = 3
_written = itertools.count(1)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark drops shuffles and broadcasts of rounds that are over and both heaps stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim_heap()
    spark.sparkContext._jvm.System.gc()


def trim_heap() -> None:
    """Gives free memory back to the system, where its C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: Rows of a file, where their number is known to be bounded.
FILE_ROWS = 25_000


def materialise(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Writes df into the shared folder and reads it back, which cuts its lineage and survives lost executors.

    rows: how many there are about, so that a small table isn't dealt over more files than that many need.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    if next(_written) % RELEASE_EVERY == 0:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialise() gave and that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


#: Rows and bytes of an Arrow batch, whichever comes first, as one text can be very long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches, the same for all operators, where the session leaves them at Spark's defaults; workers can import this package."""
    ship(spark)
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(-1))


def held_out(doc_id: Column) -> Column:
    return crc_mod4(doc_id) == 2


#: Bytes of words in lower-cased UTF-8: digits, letters, underscore and all beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


@lru_cache(1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below 2 ** bits."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full((1 << bits) - 1, x, np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64)))


def word_hashes(column: pa.Array, at_once: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, lower-cased, and where each text's words begin (one more entry than texts).

    A word's hash is that of the polynomial of its bytes: the difference of two running sums, brought back to the word's start.
    """
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    _, ends, data = low.buffers()
    ends = np.frombuffer(ends, np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, np.int64)
    text = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None and ends[-1] else np.zeros(0, np.uint8)
    # a byte more at either end, and no word goes over a text's end
    word = np.zeros(len(text) + 2, bool)
    word[1:-1] = IN_WORD[text]
    first, last = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = ends[(ends > 0) & (ends < len(text))]
    first[inner] = word[inner + 1]
    last[inner - 1] = word[inner]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(first), np.uint64)
    for a in range(0, len(first), at_once):
        f, e = first[a : a + at_once], last[a : a + at_once]
        own = text[f[0] : e[-1]]
        up, down = powers(max(20, int(len(own)).bit_length()))
        run = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own + np.uint64(1)) * up[: len(own)], out=run[1:])
        h = (run[e - f[0]] - run[f - f[0]]) * down[f - f[0]]
        h ^= h >> np.uint64(32)
        h *= MIX
        out[a : a + at_once] = h ^ h >> np.uint64(29)
    return out, np.searchsorted(first, ends)
