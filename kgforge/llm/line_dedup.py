"""Line deduplication over levelled sorted runs of line hashes.

Every batch of documents adds one run: its line keys, hashed to 128 bits, sorted and dealt into buckets by hash. Before a batch is added
it is merge-joined with the runs there are, which are never shuffled or sorted again: keys that no run has (the anti-join) are new, and
known ones take over what the runs say, so a run's rows hold the totals so far, the number of documents with the key, the largest of
their ids and the number of places, and the newest row of a key supersedes the older ones. Runs of a level are merged into one of the next
as soon as there are `fanout` of them, bucket by bucket, so a key is rewritten a logarithmic number of times. What repeats is then read off
the runs by a filter.

Keys that hold a thousandth of all places or more (a thousand keys at most) find their lines by a broadcast, the others by a merge, so no
task gets more than such a share of one key.

Defined cases: a null or empty text is one empty line; a null doc_id takes no part in the counts and keeps its lines; rows that share
doc_id and text are one document and are treated alike; a line that repeats within one document counts once and, if dropped there,
loses all its places. An empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, delete, discard, lower_ascii, materialise, new_path

KEY = ["h1", "h2"]
#: A key with one in so many of all places is hot.
HOT = 1000
#: Places for each bucket, and buckets at most.
BUCKET_PLACES, MOST_BUCKETS = 250_000, 50_000


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_table(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """doc_id, th (hash of the text), line_no and key hash of every line whose key has min_chars code points or more."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    keyed = rows.where(F.length("line") >= min_chars).withColumn("k", line_key(F.col("line"))).where(F.length("k") >= min_chars)
    return keyed.select("doc_id", "th", "line_no", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("2"), "k").alias("h2"))


class LineRuns:
    """Levelled runs (h1, h2, n_docs, keep_doc, n_places, fresh) as bucketed tables below one shared folder; `levels` is the manifest.

    A document's lines have to come in one batch.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 2, buckets: int = 8) -> None:
        self.spark, self.root, self.fanout, self.buckets = spark, root or new_path(spark, "lines"), fanout, buckets
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []
        # no rows, but buckets: the first batch is dealt out like the others, by its join
        self.none = self._write(spark.createDataFrame([], "h1 long, h2 long, n_docs long, keep_doc long, n_places long, fresh boolean"))

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"kgforge_lines_{uuid.uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/run-{len(self.tables)}").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The newest row of each key, newest runs last; a merge of the sorted buckets."""
        out = runs[0]
        for run in runs[1:]:
            a, b = out.alias("a"), run.hint("merge").alias("b")
            # totals only grow, so the larger ones are the newer ones
            both = [F.greatest(f"a.{c}", f"b.{c}").alias(c) for c in ("n_docs", "keep_doc", "n_places")]
            out = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY], "full_outer").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in KEY], *both, F.coalesce("b.fresh", "a.fresh").alias("fresh"))
        return out

    def runs(self) -> list[DataFrame]:
        return [run for level in reversed(self.levels) for run in level]

    def all_keys(self) -> DataFrame | None:
        """All keys of all runs with their totals."""
        return self._merged(self.runs()) if self.runs() else None

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys of so many documents, with their totals; only these are shuffled."""
        some = [run.where(F.col("n_docs") >= min_docs) for run in self.runs()]
        return reduce(DataFrame.unionByName, some).groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("n_docs", "keep_doc", "n_places")])

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds the batch's lines (h1, h2, doc_id) as a run and returns it; fresh marks keys that no earlier run has."""
        own = lines.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc"), F.sum("n").alias("n_places"))
        batch, totals, before_ = own, ("n_docs", "keep_doc", "n_places"), [self.none, *self.runs()]
        for k, run in enumerate(before_):
            batch = batch.join(run.select(*KEY, *[F.col(c).alias(f"{c}{k}") for c in totals]).hint("merge"), KEY, "left")
        known = lambda c: [F.col(f"{c}{k}") for k in range(len(before_))]
        before = lambda c: F.greatest(F.lit(0), F.lit(0), *known(c))
        # greatest() passes over nulls
        batch = batch.select(
            *KEY, (F.col("n_docs") + before("n_docs")).alias("n_docs"), F.greatest("keep_doc", "keep_doc", *known("keep_doc")).alias("keep_doc"),
            (F.col("n_places") + before("n_places")).alias("n_places"), F.coalesce(*known("n_docs"), F.lit(None)).isNull().alias("fresh"),
        )
        run = self._write(batch)
        self.levels = self.levels or [[]]
        self.levels[0].append(run)
        self._compact()
        return run

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(full)))
            level += 1

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.root)


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3) -> DataFrame:
    """doc_id, th and the sorted numbers of the lines to drop, for every document that loses any."""
    lines = materialise(line_table(docs, min_chars), "line-table")
    places = lines.count()
    runs = LineRuns(docs.sparkSession, buckets=min(MOST_BUCKETS, max(1, -(-places // BUCKET_PLACES))))
    for k in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    repeated = materialise(runs.repeated(min_docs).select(*KEY, "keep_doc", (F.col("n_places") * HOT >= places).alias("hot")), "repeated", places // 8)
    hot, rest = (repeated.where(F.col("hot") == x).select(*KEY, "keep_doc") for x in (True, False))
    # HOT rows at most
    told = lines.join(F.broadcast(hot), KEY, "left")
    lost = told.where("keep_doc IS NOT NULL").unionByName(told.where("keep_doc IS NULL").drop("keep_doc").join(rest.hint("merge"), KEY).select(*told.columns)).where("doc_id <> keep_doc")
    out = materialise(lost.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("drop")), "lost-lines", places // 8)
    runs.drop()
    discard(lines, repeated)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3) -> DataFrame:
    """docs with the text less its repeated lines, and n_lines and n_dropped."""
    drop = repeated_lines(docs, min_chars, min_docs, batches).withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    joined = docs.join(drop, (docs["doc_id"] == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_th")), "left")
    lines = lines_of(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    # by way of an array of one, so that a text is split once and not for each line
    joined_lines = F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(kept, lambda i: F.get(own, i)), "\n")), F.lit(0))
    # no line is touched in most documents, and those keep their text as it is
    text = F.when(F.col("drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(joined_lines)
    out = joined.withColumns({"_n": F.size(lines).cast("long"), "_d": F.coalesce(F.size("drop"), F.lit(0)).cast("long"), "_t": text})
    return out.select(*[F.col("_t").alias("text") if c == "text" else docs[c] for c in docs.columns], F.col("_n").alias("n_lines"), F.col("_d").alias("n_dropped"))


def op2(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no
  FROM documents),
k AS (SELECT doc_id, no, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.keep IS NOT NULL AND k.doc_id <> r.keep AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
