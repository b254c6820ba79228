"""Tables of the engine as Parquet folders of versions: writes go to new folders, and one marker publishes them together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Child tables and the keys that a deleted parent takes with it.
CASCADES = {"documents": {"chunks": "document_id", "citations": "document_id"}, "questions": {"answers": "question_id", "citations": "question_id"}, "answers": {"citations": "question_id"}}


class Store:
    """Each table is root/name/<version>; root/_current is a log of markers, each with the versions that one write published.

    A write reads the current versions and leaves them as they are, so a failed job
    changes nothing and a running reader is not disturbed; a marker is one file, so tables written together
    are seen together. Files are reached by Spark alone."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_current")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("n long, versions map<string, string>").parquet(f"{self.root}/_current")

    def _version(self, name: str) -> str | None:
        log = self._log()
        held = F.col("versions")[name]
        return None if log is None else log.where(held.isNotNull()).agg(F.max_by(held, "n").alias("version")).first()["version"]

    def exists(self, name: str) -> bool:
        return self._version(name) is not None

    def read(self, name: str) -> DataFrame:
        version = self._version(name)
        if version is None:
            raise ValueError(f"no table is called {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def staged(self, rows: DataFrame) -> DataFrame:
        """rows written once to a folder of their own, seen by no reader."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def publish(self, tables: dict[str, DataFrame]) -> None:
        """Writes new versions of the tables, then shows all of them at once."""
        versions = {name: uuid.uuid4().hex for name in tables}
        for name, rows in tables.items():
            rows.write.parquet(f"{self.root}/{name}/{versions[name]}")
        log = self._log()
        n = 0 if log is None else log.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
        self.spark.createDataFrame([(n + 1, versions)], "n long, versions map<string, string>").coalesce(1).write.mode("append").parquet(f"{self.root}/_current")

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        self.publish({name: rows})
        return self.read(name)

    def replaced(self, name: str, rows: DataFrame, key: list[str]) -> DataFrame:
        """The table with rows in place of those of their keys."""
        if not self.exists(name):
            return rows
        return self.read(name).join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)

    def delete(self, name: str, ids: DataFrame, key: str) -> None:
        """Rows of the keys go, and their children; answers outlive the documents they cite."""
        keys = ids.select(key).distinct()
        gone = {name: key, **CASCADES.get(name, {})}
        held = {table: self.read(table) for table in gone if self.exists(table)}
        self.publish({table: rows.join(keys.withColumnRenamed(key, gone[table]), gone[table], "left_anti") for table, rows in held.items()})
