"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing puts each record in a gzip member of its own and notes file, offset, length, URL and digest in an index table. Reading starts
from any selection of index rows: they are sorted by place, neighbours closer than `gap` bytes are fetched as one range, and each
record is cut out of its range. Of records with equal payloads the one with the smallest page_id holds the payload; the others are
revisits that name it.

Files go through pyarrow's file systems, so the shared folder can be in any store that has one. A task writes files of its own name; a
repeated attempt writes others, and only those in the index are ever read.

Defined cases: a null html is an empty payload; a null url leaves out the target; a null page_id is a revisit if another record has
its payload under an id, else a response; rows equal in page_id and payload are all responses or all revisits of the same record; an
empty table gives an empty index and result. Only page_id, url and html are looked at.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path, small_batches

INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
SALTS = 16
ROLL = 256 << 20
#: Reading tasks at most; ranges are coalesced within a task.
READERS = 20_000


def _schema(fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


INDEX_ARROW = _schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
READ_ARROW = _schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record, without compression. first: the page_id that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~\'')}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The named fields and the HTTP block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, fields["payload"] = block.partition(b"\r\n\r\n")
    fields["http-length"] = int(http.decode().rpartition("Content-Length: ")[2])
    return fields


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with the same payload, null if it is this row's."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.unhex(F.sha1(F.col("html").cast("binary"))).alias("digest")
    groups = rows.select("page_id", digest).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.select("*", digest, F.pmod(F.hash("page_id"), F.lit(SALTS)).alias("salt"))
    return salted.join(groups, ["digest", "salt"], "left").select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, root: str | None = None, date: str = "2000-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes the archives below root and returns their index, itself written before anything reads it."""
    spark = pages.sparkSession
    small_batches(spark)
    root = root or new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    if out is None or offset >= ROLL:
                        if out is not None:
                            out.close()
                        name, offset = f"{base}/part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(name, compression=None)
                    payload = html.encode()
                    digest = base32_sha1(payload)
                    packer = zlib.compressobj(level, wbits=31)
                    data = packer.compress(record(page_id, url, payload, digest, first, date)) + packer.flush()
                    out.write(data)
                    rows.append((page_id, url, digest, len(payload), "response" if first is None else "revisit", first, name, offset, len(data)))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), INDEX_ARROW, strict=True)], schema=INDEX_ARROW) if rows else pa.RecordBatch.from_pylist([], INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    index = materialise(with_first(pages).mapInArrow(write, INDEX), "warc-index")
    index.archive_root = root
    return index


def read_records(index: DataFrame, root: str, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that the index rows select, each checked against its digest."""
    small_batches(index.sparkSession)

    def cut(data: bytes, start: int, wanted: list[tuple[int, int]]) -> Iterator[tuple]:
        for offset, length in wanted:
            x = parse(zlib.decompress(data[offset - start : offset - start + length], wbits=31))
            digest = x["warc-payload-digest"].removeprefix("sha1:")
            whole = x["warc-type"] == "response"
            if whole and base32_sha1(x["payload"]) != digest:
                raise ValueError(f"payload of page {x.get('x-page-id')} does not match its digest")
            number = lambda k: int(x[k]) if k in x else None
            yield number("x-page-id"), len(x["payload"]) if whole else x["http-length"], digest, x["warc-type"], number("x-refers-to-page-id"), x.get("warc-target-uri")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        opened: list = ["", None]

        def fetch(name: str, wanted: list[tuple[int, int]]) -> pa.RecordBatch:
            if opened[0] != name:
                if opened[1] is not None:
                    opened[1].close()
                opened[:] = [name, store.open_input_file(name)]
            start, end = wanted[0][0], wanted[-1][0] + wanted[-1][1]
            rows = list(cut(opened[1].read_at(end - start, start), start, wanted))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), READ_ARROW, strict=True)], schema=READ_ARROW)

        name, wanted = "", []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if wanted and (file != name or offset - sum(wanted[-1]) > gap or offset + length - wanted[0][0] > most):
                    yield fetch(name, wanted)
                    wanted = []
                name = file
                wanted.append((offset, length))
        if wanted:
            yield fetch(name, wanted)
        if opened[1] is not None:
            opened[1].close()

    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    # the index is small, so its size says nothing of the work: tasks are counted by the bytes to read
    places = index.select("file", "offset", "length").repartition(min(READERS, max(1, -(-total // (2 * most)))), "file", F.floor(F.col("offset") / most)).sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, READ)


def op10(pages: DataFrame) -> DataFrame:
    index = write_archives(pages)
    return read_records(index, index.archive_root).drop("url")


#: Base 32 of the 20 bytes: eight groups of five hexadecimal digits are four letters each.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT p.page_id, p.html, g.first, list_transform(range(8), lambda i: CAST('0x' || substr(p.h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM p JOIN g ON p.h = g.h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v[CAST(j // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
