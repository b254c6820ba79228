"""Ingestion of files as they arrive, by Structured Streaming's file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ingest
from ..sources.store import Store

FILE_FIELDS = "path string, modificationTime timestamp, length long, content binary"


def ingest_arriving(spark: SparkSession, folder: str, store: Store, checkpoint: str, pattern: str = "*") -> None:
    """Ingests the files of a folder that no earlier call has seen, then returns.

    Batches repeat safely: contents that are stored already are skipped by their hash."""
    files = spark.readStream.format("binaryFile").schema(FILE_FIELDS).option("pathGlobFilter", pattern).load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        ingest(rows.select("path", "content", F.col("modificationTime").alias("modified")), store)

    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by type and window, for a stream or a table; events later than `late` are dropped by a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
