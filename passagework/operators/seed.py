"""Fills a store with documents and question sets: what is there already is left alone, so it can run again at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from .ingest import ingest
from .providers import Provider, Settings, provider
from .review import draft_pending, import_csv

EVENTS = "question_id string, seq int, at timestamp, kind string, status string, text string"
TABLES = ("documents", "chunks", "files", "sets", "questions", "events", "citations")


def opened(spark: SparkSession, settings: Settings) -> tuple[Store, Provider]:
    """The store and the provider that the settings name."""
    return Store(spark, settings.store), provider(settings.provider, settings.embeddings)


def seed(spark: SparkSession, settings: Settings, files: DataFrame, sets: DataFrame, reset: bool = False) -> dict[str, int]:
    """How many documents, sets and drafts were added. files: path, content, modified; sets: name, csv.

    Files whose content is stored, and sets whose name is, are left out; then answers to pending questions are drafted, batch after batch, until none is left or none can be.
    reset empties the store first."""
    store, writer = opened(spark, settings)
    if reset:
        store.publish({name: store.read(name).limit(0) for name in TABLES if store.exists(name)})
    added = ingest(files, store, provider=writer, largest_mb=settings.max_upload_mb).count()
    fresh = sets if not store.exists("sets") else sets.join(store.read("sets"), "name", "left_anti")
    read = store.staged(import_csv(fresh.dropDuplicates(["name"]).select(F.md5(F.col("name").cast("binary")).alias("set_id"), "name", "csv")))
    good = read.where("error IS NULL AND question IS NOT NULL")
    names = good.select("set_id", "name").distinct()
    questions = good.select("set_id", F.concat_ws("#", "set_id", F.col("idx").cast("string")).alias("question_id"), "idx", "question")
    more = lambda name, rows: store.read(name).unionByName(rows) if store.exists(name) else rows
    store.publish({"sets": more("sets", names), "questions": more("questions", questions)})
    drafted = 0
    while True:
        events = store.read("events") if store.exists("events") else spark.createDataFrame([], EVENTS)
        drafts, cited, _ = draft_pending(store.read("questions"), events, store.read("chunks"), store.read("documents").where("status = 'READY'"), writer)
        drafts, cited = store.staged(drafts), store.staged(cited)
        if not (n := drafts.count()):
            return {"documents": added, "sets": names.count(), "drafts": drafted}
        drafted += n
        store.publish({"events": more("events", drafts.select(*[F.col(c).cast(t) for c, t in (f.split(" ") for f in EVENTS.split(", "))])), "citations": more("citations", cited)})
