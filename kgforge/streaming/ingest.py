"""Continuous forms of ingestion and of the life of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgforge.functions.identity import content_hash


def new_documents(spark: SparkSession, path: str, schema: str, key: str = "content_id") -> DataFrame:
    """Documents of a folder as files arrive, each content once; the state holds the hashes seen."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn(key, content_hash(F.col("text"))).dropDuplicates([key])


def ingest(documents: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Works off what has arrived and stops; a later call goes on where this one ended."""
    return documents.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ingest_with_links(documents: DataFrame, collection: str, target: str, links: str, checkpoint: str, chunks_of) -> StreamingQuery:
    """Batch by batch: contents that the target lacks are added with their chunks, links to collections always are."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("content_id", content_hash(F.col("text")))
        # a batch that is tried again overwrites its own part
        old = [p for p in _parts(spark, target) if not p.endswith(f"/batch={number}")]
        fresh = rows.dropDuplicates(["content_id"])
        if old:
            fresh = fresh.join(spark.read.parquet(*old).select("content_id"), "content_id", "left_anti")
        chunks_of(fresh).write.mode("overwrite").parquet(f"{target}-chunks/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows.select("content_id", F.col(collection).alias("collection_name")).distinct().write.mode("overwrite").parquet(f"{links}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in store.listStatus(at)] if store.exists(at) else []


def status_counts(units: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Units by status and event-time window; events later than the watermark are left out."""
    return units.withWatermark("ts", lateness).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n_units"))
