"""Documents, their collections and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgforge.functions.identity import chunk_id, content_hash
from kgforge.functions.text import is_blank
from kgforge.functions.values import bound


def with_content_id(documents: DataFrame, content: str = "text") -> DataFrame:
    return documents.withColumn("content_id", content_hash(F.col(content)))


def first_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the first by order: insert or ignore, the same in any run."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others])


def unseen(new: DataFrame, stored: DataFrame, key: str = "content_id") -> DataFrame:
    return new.join(stored.select(key), key, "left_anti")


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key, by order; a new row wins a tie."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    others = [c for c in stored.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, "_new")).alias("_last"))
    return latest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def existing(rows: DataFrame, keys: DataFrame, key: str = "content_id") -> DataFrame:
    """The stored rows that some of the keys ask for."""
    return rows.join(keys.select(key), key, "left_semi")


def collections_of(links: DataFrame, key: str = "content_id") -> DataFrame:
    """The collections of each document, in order."""
    return links.groupBy(key).agg(F.sort_array(F.collect_set("collection_name")).alias("collections"))


def gained(before: Column, after: Column) -> Column:
    """How many of a group's values are only among the later ones."""
    return F.size(F.array_except(F.collect_set(after), F.collect_set(before))).cast("bigint")


def memberships(documents: DataFrame, collection: str, key: str = "content_id") -> DataFrame:
    return documents.select(key, F.col(collection).alias("collection_name")).distinct()


def collected(documents: DataFrame, collection: str, carried: str, order: Column, key: str = "content_id") -> DataFrame:
    """One row a content, with its collections and what the first of its documents carries; texts aren't shuffled, and hashed once."""
    return documents.groupBy(key).agg(F.collect_set(collection).alias("collections"), F.min_by(carried, order).alias(carried))


def counts_by_collection(collections: DataFrame, links: DataFrame, key: str = "content_id") -> DataFrame:
    """Documents and characters of every collection, those without any included; links: a row a content and collection, with n_chars."""
    counts = links.groupBy("collection_name").agg(F.count(key).alias("n_documents"), F.sum("n_chars").alias("n_chars"))
    joined = collections.join(counts, "collection_name", "left")
    return joined.select("collection_name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def in_several(links: DataFrame, key: str = "content_id") -> DataFrame:
    return links.groupBy(key).agg(F.count("*").alias("n_collections")).where("n_collections > 1")


def without_chunks(documents: DataFrame, chunks: DataFrame, key: str = "content_id") -> DataFrame:
    return documents.join(chunks.select(key), key, "left_anti")


def totals_before(sizes: Column, block: int = 64) -> Column:
    """For each of the sizes the sum of those before it; by blocks, so the work isn't the square of their number."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    at = lambda k: F.floor(k / block).cast("int")

    def sums(own: Column) -> Column:
        of_blocks = F.transform(F.sequence(F.lit(0), at(F.greatest(F.size(own) - 1, F.lit(0)))), lambda k: total(F.slice(own, k * block + 1, F.lit(block))))
        before = bound(of_blocks, lambda b: F.transform(b, lambda _, k: total(F.slice(b, F.lit(1), k))))
        return bound(before, lambda b: F.transform(own, lambda _, k: F.get(b, at(k)) + total(F.slice(own, at(k) * block + 1, F.pmod(k, F.lit(block))))))

    return bound(sizes, sums)


def line_chunks(documents: DataFrame, key: str = "content_id", content: str = "text") -> DataFrame:
    """A chunk for each line that isn't blank, numbered without gaps, with its place in the text."""

    def placed(lines: Column) -> Column:
        starts = totals_before(F.transform(lines, lambda x: F.length(x) + 1))
        return F.filter(F.arrays_zip(starts.alias("start"), lines.alias("content")), lambda s: F.length(F.trim(s["content"])) > 0)

    spans = documents.select(key, bound(F.split(content, "\n", -1), placed).alias("spans"))
    out = spans.select(key, F.posexplode("spans").alias("chunk_index", "s"))
    return out.select(key, "chunk_index", chunk_id(F.col(key), F.col("chunk_index")).alias("chunk_id"), F.col("s.start").alias("start_offset"), (F.col("s.start") + F.length("s.content")).alias("end_offset"), F.col("s.content").alias("content"))


def with_neighbour(chunks: DataFrame, value: Column, name: str, key: str = "content_id", index: str = "chunk_index") -> DataFrame:
    """chunks with the value that the chunk before has; null for the first."""
    return chunks.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(index)))


def rebuilt(chunks: DataFrame, key: str = "content_id") -> DataFrame:
    """A document's text from its chunks: overlaps once, a line feed where there is a gap."""
    earlier = Window.partitionBy(key).orderBy("start_offset", "end_offset", "content").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("_end", F.max("end_offset").over(earlier))
    gap = F.when(F.col("start_offset") > F.col("_end"), "\n").otherwise("")
    part = F.when(F.coalesce("_end", F.lit(0)) < F.col("end_offset"), F.concat(gap, F.substr("content", F.greatest(F.coalesce("_end", F.lit(0)) - F.col("start_offset"), F.lit(0)) + 1)))
    parts = F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", part.alias("part"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))


def changed(documents: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose content is no longer what was stored under the same key."""
    now = documents.select(key, content_hash(F.col("text")).alias("found_id"))
    return stored.select(key, "content_id").join(now, key).where("content_id <> found_id")


def not_blank(documents: DataFrame, content: str = "text") -> DataFrame:
    return documents.where(~is_blank(F.col(content)))
