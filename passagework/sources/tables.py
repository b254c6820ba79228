"""Tables on the way: scans dealt to all cores, intermediate tables in the shared folder, batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch at most; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan, dealt anew where it has fewer than two splits for each core.

    A small file with one row group is read by one task, and so would be all that follows it. What is dealt is bounded by the
    splits' size: two for each core at most; larger scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < 2 * cores else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; one of its own is set only where Spark runs in one process and none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows as Parquet in the path, else in a folder of the shared one, read back: made once, however often they are used."""
    path = path or f"{shared_folder(rows.sparkSession)}/made-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_batches(rows: DataFrame) -> DataFrame:
    """rows, in a session whose Arrow batches hold BATCH_BYTES at most. The setting is the session's: Spark has none for one job."""
    conf = rows.sparkSession.conf
    bound = conf.get(BYTES_SETTING).rstrip("bB")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        conf.set(BYTES_SETTING, BATCH_BYTES)
    return rows
