"""Files to documents and passages: kinds, hashes, dedup against what is stored, reading, cutting; failures become rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import choose_title, file_kind, squash
from ..sources import readers
from ..sources.store import Store
from ..sources.tables import small_batches, written
from .chunk import Options, chunk_blocks
from .embedding import embedded_passages
from .providers import Offline, Provider
from .salience import salient
from .summary import outlined

LARGEST_MB, LONGEST_ERROR = 10, 1_000
#: Letters and digits of a key point by which its passage is found.
BEGINNING = 120
VERSION = 2
CHUNK = pa.struct([("chunk_index", pa.int32()), ("content", pa.string()), ("heading", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32())])
OUTLINE = pa.list_(pa.struct([("heading", pa.string()), ("level", pa.int32()), ("chunk_index", pa.int32())]))
CANDIDATES = pa.list_(pa.struct([("text", pa.string()), ("bonus", pa.float64())]))
READ = (
    "detected string, error string, error_code int, char_count int, chunks array<struct<chunk_index:int, content:string, heading:string, page_start:int, page_end:int>>, "
    "abstract string, outline array<struct<heading:string, level:int, chunk_index:int>>, candidates array<struct<text:string, bonus:double>>"
)


def new_files(files: DataFrame, stored: DataFrame | None, model: str, largest: int = LARGEST_MB << 20) -> DataFrame:
    """Files (path, content, modified) with filename, kind, sha256 and refused; one of each content, and none that is stored and up to date."""
    named = files.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    size = F.length("content")
    known = named.select(
        "*",
        file_kind(F.col("filename"), F.lit(None).cast("string")).alias("kind"),
        F.sha2("content", 256).alias("sha256"),
        F.when(size > largest, refusal(413, "the file is too large")).when(size == 0, refusal(422, "the file is empty")).alias("refused"),
    )
    one = known.groupBy("sha256").agg(F.min("path").alias("path"))
    fresh = known.join(one, ["sha256", "path"], "left_semi")
    if stored is None:
        return fresh
    return fresh.join(freshness(stored, model=model).where("status = 'READY' AND NOT outdated").select("sha256"), "sha256", "left_anti")


def refusal(code: int, text: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(text).alias("text"))


def read_files(files: DataFrame, options: Options | None = None) -> DataFrame:
    """files with what was read of each: title found, error, char_count, chunks, summary. A file that fails fails alone."""

    def one(row: dict) -> dict:
        try:
            if row["refused"]:
                raise readers.ReadError(row["refused"]["text"], row["refused"]["code"])
            title, blocks = readers.read(row["kind"], row["content"])
            chunks = chunk_blocks(blocks, options)
            if not chunks:
                raise readers.ReadError("the file holds no passages")
            s, candidates = outlined(blocks, chunks)
        except Exception as problem:  # noqa: BLE001 - any failure of a reader belongs to its document
            return {"detected": None, "error": str(problem)[:LONGEST_ERROR], "error_code": getattr(problem, "code", 500), "char_count": 0, "chunks": [], "abstract": None, "outline": None, "candidates": []}
        return {
            "detected": title,
            "error": None,
            "error_code": None,
            "char_count": sum(len(b.text) for b in blocks),
            "chunks": [{"chunk_index": c.index, "content": c.content, "heading": c.heading, "page_start": c.page_start, "page_end": c.page_end} for c in chunks],
            "abstract": s.abstract,
            "outline": [{"heading": h, "level": n, "chunk_index": c} for h, n, _, c in s.outline],
            "candidates": [{"text": t, "bonus": b} for t, b, _ in candidates],
        }

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [pa.field("detected", pa.string()), pa.field("error", pa.string()), pa.field("error_code", pa.int32()), pa.field("char_count", pa.int32()), pa.field("chunks", pa.list_(CHUNK)), pa.field("abstract", pa.string()), pa.field("outline", OUTLINE), pa.field("candidates", CANDIDATES)]
        for part in parts:
            for row in range(part.num_rows):  # one file at a time, however many came in the batch
                some = part.slice(row, 1)
                out = pa.RecordBatch.from_pylist([one(r) for r in some.to_pylist()], schema=pa.schema(made))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("sha256", "filename", "modified")), *out.columns], names=["sha256", "filename", "modified", *out.schema.names])

    rows = files.select("sha256", "filename", "modified", "kind", "content", "refused")
    made = written(small_batches(rows).mapInArrow(run, f"sha256 string, filename string, modified timestamp, {READ}").withColumn("file", F.monotonically_increasing_id()))
    summary = F.when(F.col("error").isNull(), F.struct("abstract", F.coalesce("key_points", F.array().cast(POINTS)).alias("key_points"), "outline"))
    return made.join(key_points(made), "file", "left").withColumn("summary", summary).drop("file", "abstract", "outline", "candidates", "key_points")


POINTS = "array<struct<text:string, chunk_index:int>>"


def key_points(read: DataFrame) -> DataFrame:
    """file, key_points: the most salient candidates of each file, in the order of the text, with the first passage that holds their beginning."""
    sentences = read.select("file", F.posexplode("candidates").alias("ord", "c")).select("file", "ord", "c.text", "c.bonus")
    chosen = salient(sentences, "file").join(sentences, ["file", "ord"]).join(read.select("file", "chunks"), "file")
    holding = F.filter("chunks", lambda c: squash(c["content"]).contains(F.left(squash(F.col("text")), F.lit(BEGINNING))))
    points = F.array_sort(F.collect_list(F.struct("ord", "text", F.get(holding, 0)["chunk_index"].alias("chunk_index"))))  # KEY_POINTS of them
    return chosen.groupBy("file").agg(F.transform(points, lambda p: F.struct(p["text"].alias("text"), p["chunk_index"].alias("chunk_index"))).alias("key_points"))


def blocks_of_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ord, kind, level, text of the blocks of every HTML page, read where the page is."""
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 200):
                some = part.slice(at, 200)
                found = [readers.html_blocks(t or "") for t in some.column("html").to_pylist()]
                owner = pa.array([n for n, bs in enumerate(found) for _ in bs], pa.int64())
                flat = [b for bs in found for b in bs]
                columns = [pa.array([n for bs in found for n in range(len(bs))], pa.int32()), pa.array([b.kind for b in flat], pa.string()), pa.array([b.level for b in flat], pa.int32()), pa.array([b.text for b in flat], pa.string())]
                yield pa.RecordBatch.from_arrays([some.column("key").take(owner), *columns], names=["key", "ord", "kind", "level", "text"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ord int, kind string, level int, text string").withColumnRenamed("key", key)


def documents_of(read: DataFrame, provider: Provider) -> DataFrame:
    """Rows of documents, with their chunks, from what read_files() returns, to be searched by the provider's embeddings. Content hashes are their ids."""
    return read.select(
        F.col("sha256").alias("document_id"),
        "sha256",
        choose_title(F.col("detected"), F.col("filename")).alias("title"),
        "filename",
        F.when(F.col("error").isNull(), "READY").otherwise("FAILED").alias("status"),
        "error",
        "error_code",
        "char_count",
        "summary",
        F.lit(VERSION).alias("pipeline_version"),
        F.lit(provider.embedding_model).alias("embedding_model"),
        F.col("modified").alias("created"),
        "chunks",
    )


def ingest(files: DataFrame, store: Store, options: Options | None = None, provider: Provider | None = None, largest_mb: int = LARGEST_MB) -> DataFrame:
    """Reads new files into the store's documents, chunks and files, published together; returns the documents written."""
    provider = provider or Offline()
    stored = store.read("documents") if store.exists("documents") else None
    fresh = store.staged(new_files(files, stored, provider.embedding_model, largest_mb << 20))
    staged = store.staged(documents_of(read_files(fresh, options), provider))
    kept = fresh.where("refused IS NULL").select(F.col("sha256").alias("document_id"), "filename", "kind", "modified", "content")
    publish(store, staged, provider, {"files": kept})
    return staged.drop("chunks")


def passages_of(documents: DataFrame, provider: Provider) -> DataFrame:
    """The passages of documents that could be read, with the provider's vectors."""
    return embedded_passages(documents.where("status = 'READY'").select("document_id", "title", F.inline("chunks")), provider)


def publish(store: Store, documents: DataFrame, provider: Provider, others: dict[str, DataFrame] | None = None) -> None:
    """Documents and their chunks in place of those of the same ids; one marker makes all of it visible. A document that failed keeps the chunks it had."""
    rows = {"chunks": passages_of(documents, provider), "documents": documents.drop("chunks"), **(others or {})}
    store.publish({name: store.replaced(name, some, ["document_id"]) for name, some in rows.items()})


def freshness(documents: DataFrame, version: int = VERSION, model: str | None = None) -> DataFrame:
    """documents with outdated: whether a document was read by an earlier version, or embedded by another model than is searched by, and should be read again."""
    other = F.lit(False) if model is None else ~F.col("embedding_model").eqNullSafe(F.lit(model))
    return documents.withColumn("outdated", ((F.col("pipeline_version") < version) | other) & (F.col("status") != "PROCESSING"))


def reprocess(ids: DataFrame, store: Store, options: Options | None = None, provider: Provider | None = None) -> DataFrame:
    """Reads the stored files of the documents (document_id) again and replaces their chunks; citations of these go."""
    provider = provider or Offline()
    files = store.read("files").join(ids.select("document_id").distinct(), "document_id", "left_semi")
    none = F.lit(None).cast("struct<code:int, text:string>")
    again = files.select(F.col("document_id").alias("sha256"), "filename", "modified", "kind", "content", none.alias("refused"))
    staged = store.staged(documents_of(read_files(again, options), provider))
    citations = {}
    if store.exists("citations"):
        done = staged.where("status = 'READY'").select("document_id")
        citations = {"citations": store.read("citations").join(done, "document_id", "left_anti")}
    tables = {"chunks": passages_of(staged, provider), "documents": staged.drop("chunks")}
    store.publish({name: store.replaced(name, rows, ["document_id"]) for name, rows in tables.items()} | citations)
    return staged.drop("chunks")
