"""Streaming ingestion: new documents of a folder are de-duplicated, chunked and merged into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, path: str, schema: str, most_files: int = 100) -> DataFrame:
    """Documents as their files arrive, with their content's hash."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)
    return rows.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))


def first_seen(stream: DataFrame, at: str, late: str) -> DataFrame:
    """Each content once within the watermark, so that the state stays bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(["content_hash"])


def merged_into(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``merge``; batches that were done are not handed on again as their ids are known."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Event counts by key and tumbling window, final once the watermark has passed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
