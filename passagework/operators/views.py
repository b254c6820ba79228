"""What a page shows of the store: a document with its passages, an answer with its citations and where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(parents: DataFrame, key: str, children: DataFrame, parent: str, order: list[str], fields: list[Column | str], name: str) -> DataFrame:
    """parents with the array `name`: the fields of each one's children in their order, none for those without. A parent's children are what one row can hold."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("order"), F.struct(*fields).alias("child"))))
    held = children.groupBy(F.col(parent).alias(key)).agg(F.transform(sorted_, lambda c: c["child"]).alias(name))
    kind = held.schema[name].dataType
    return parents.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def document_view(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents with their passages in order, and how many there are."""
    fields = ["chunk_index", "content", "heading", "page_start", "page_end"]
    return nested(documents, "document_id", chunks, "document_id", ["chunk_index"], fields, "passages").withColumn("n_passages", F.size("passages"))


def answer_view(answers: DataFrame, citations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """answers (question_id, ...) with their citations in order, each with the title of its document and the heading and pages of its passage.

    What is cited may have gone since; then title, heading and pages are null."""
    placed = citations.join(documents.select("document_id", "title"), "document_id", "left").join(chunks.select("document_id", "chunk_index", "heading", "page_start", "page_end"), ["document_id", "chunk_index"], "left")
    fields = ["ord", "document_id", "title", "chunk_index", "heading", "page_start", "page_end", "quote", "verified"]
    return nested(answers, "question_id", placed, "question_id", ["ord"], fields, "citations")
