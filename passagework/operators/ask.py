"""Answering many questions at once over a table of passages: route, search, gate, write, verify."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import names_document, question_plan
from ..sources.tables import written
from . import answer as A
from . import extract
from . import search as S
from .citations import resolved
from .embedding import embedded_passages, in_context
from .providers import Offline, Provider, with_retry
from .salience import gist

OVERVIEW_DOCUMENTS = 3
#: Passages for each document of an overview, by how many there are.
OVERVIEW_PASSAGES = {1: 8, 2: 5, 3: 4}
SOURCE = "struct<document_id:string, title:string, chunk_index:int, content:string, heading:string, page_start:int, page_end:int>"


def routed(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """question_id, document_id of the questions that ask for an overview: of the documents they name, else of the newest.

    documents: document_id, title, created, and points if key points are known. Up to OVERVIEW_DOCUMENTS each, newest first, then by id."""
    planned = questions.select("question_id", question_plan(F.col("question")).alias("plan"))
    newest = documents.orderBy(F.desc("created"), "document_id").limit(OVERVIEW_DOCUMENTS)
    about_all = planned.where("plan.overview").select("question_id").crossJoin(F.broadcast(newest.select("document_id", "created")))  # three rows
    # a title names the topic only if it holds one of its words, so pairs meet on the first
    named = planned.where("NOT plan.overview AND plan.asks").withColumn("word", F.col("plan.topic")[0])
    from ..functions.text import unique_tokens

    titles = documents.withColumn("word", F.explode(unique_tokens(F.col("title"))))
    about_named = named.join(titles, "word").where(names_document(F.col("plan"), F.col("title"))).select("question_id", "document_id", "created")
    return S.ranked(about_all.unionByName(about_named), "question_id", F.desc("created"), F.col("document_id"), at_most=OVERVIEW_DOCUMENTS).select("question_id", "document_id")


def overview_passages(chunks: DataFrame, wanted: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """question_id, rank, source: the passages that give the gist of each wanted (question_id, document_id).

    points: document_id, points (chunk indexes of a document's key points), if they are known."""
    counted = wanted.withColumn("n", F.count("*").over(W.partitionBy("question_id")))
    needed = chunks.join(counted.select("document_id", "n").distinct(), "document_id")
    none = F.array().cast("array<int>")
    needed = needed.withColumn("points", none) if points is None else needed.join(points.select("document_id", "points"), "document_id", "left").withColumn("points", F.coalesce("points", none))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in OVERVIEW_PASSAGES.items() for x in pair]), F.col("n").cast("int"))
    places = gist(needed.select("document_id", "n", "points", "chunk_index", "content", "heading"), ["document_id", "n"], limit).select("document_id", "n", "chunk_index")
    found = counted.join(places, ["document_id", "n"]).join(chunks, ["document_id", "chunk_index"])
    return found.select("question_id", F.row_number().over(W.partitionBy("question_id").orderBy("document_id", "chunk_index")).alias("rank"), source().alias("source"))


def source():  # noqa: ANN201
    return F.struct("document_id", "title", "chunk_index", "content", "heading", "page_start", "page_end").cast(SOURCE)


def searched(questions: DataFrame, chunks: DataFrame, tuning: S.Tuning = S.TUNING, provider: Provider | None = None) -> DataFrame:
    """question_id, rank, source: the relevant passages of each question, best first.

    Passages that carry an embedding_model are searched only if it is the provider's, and by their stored `embedding`; without stored ones, the offline provider's are made on
    the way, and another provider embeds the passages first. The provider's threshold is the least cosine of a relevant passage."""
    provider = provider or Offline()
    if "embedding_model" in chunks.columns:
        chunks = chunks.where(F.col("embedding_model") == provider.embedding_model)
    stored = "embedding" in chunks.columns
    if not stored and type(provider).embed is not Offline.embed:
        chunks, stored = embedded_passages(chunks, provider), True
    tuning = replace(tuning, least_score=provider.relevance_threshold)
    keyed = chunks.withColumn("chunk", F.concat_ws("#", "document_id", "chunk_index"))
    how = {"embedding": F.col("embedding"), "embed": provider.embed} if stored else {}
    scores = S.pair_scores(questions, "question_id", F.col("question"), keyed, "chunk", in_context(), tuning, **how)
    full = scores.join(questions, "question_id").join(keyed.select("chunk", "heading"), "chunk")
    top = S.relevant(S.hybrid(full, "question_id", "chunk", F.col("heading"), F.col("question"), tuning), tuning).select("question_id", "rank", "chunk")
    return top.join(keyed, "chunk").select("question_id", "rank", source().alias("source"))


def ask(questions: DataFrame, chunks: DataFrame, documents: DataFrame | None = None, provider: Provider | None = None) -> DataFrame:
    """question_id, question and the answer, mode, confidence, insufficient, citations, error of every question.

    questions: question_id, question; chunks: document_id, title, chunk_index, content, heading, page_start,
    page_end; documents as for routed(), none if no overviews are wanted. Questions without
    relevant passages are insufficient without asking the provider. A provider that writes as the offline one does answers all questions
    at once, by extract.answers(); overviews, and other providers, write one question at a time from its dozen passages."""
    provider = provider or Offline()
    shown = searched(questions, chunks, provider=provider).withColumn("mode", F.lit("answer"))
    if documents is not None:
        points = documents.select("document_id", "points") if "points" in documents.columns else None
        gists = overview_passages(chunks, routed(questions, documents), points).withColumn("mode", F.lit("overview"))
        shown = shown.join(gists.select("question_id").distinct(), "question_id", "left_anti").unionByName(gists)
    number = F.row_number().over(W.partitionBy("question_id").orderBy("rank"))  # what was not relevant leaves no gap
    shown = written(shown.select("question_id", "mode", number.alias("number"), F.col("source.*")).withColumnRenamed("number", "source"))
    by_rows = type(provider).generate is Offline.generate
    modes = shown.groupBy("question_id").agg(F.first("mode").alias("mode"))
    asked = questions.select("question_id", "question").join(modes, "question_id", "left")
    one_by_one = asked.where("mode = 'overview'" if by_rows else "mode IS NOT NULL")
    made = _written(one_by_one, shown, provider).unionByName(asked.where("mode IS NULL").select("question_id", *_said(A.INSUFFICIENT)))
    if by_rows:
        found = extract.answers(asked.where("mode = 'answer'"), "question_id", "question", shown.where("mode = 'answer'"))
        made = made.unionByName(found.withColumns({"mode": F.lit("answer"), "error": F.lit(None).cast("string")}))
    made = written(made)
    each = F.array_sort(F.collect_list(F.struct("ord", "source", "document_id", "chunk_index", "quote", "verified")))  # one answer's citations
    cited = resolved(made, shown).groupBy("question_id").agg(each.alias("cited"))
    both = questions.select("question_id", "question").join(made.drop("citations"), "question_id").join(cited, "question_id", "left")
    return both.select("question_id", "question", "answer", "mode", "confidence", "insufficient", F.coalesce("cited", F.array().cast(CITATIONS)).alias("citations"), "error")


CITATIONS = "array<struct<ord:int, source:int, document_id:string, chunk_index:int, quote:string, verified:boolean>>"
RAW = "array<struct<source:double, quote:string>>"
SAID = {"answer": "string", "mode": "string", "confidence": "string", "insufficient": "boolean", "citations": RAW, "error": "string"}


def _said(answer: A.Answer) -> list[Column]:
    """The columns of an answer without citations."""
    values = {"answer": answer.text, "mode": "answer", "confidence": answer.confidence, "insufficient": answer.insufficient, "error": None}
    return [(F.array() if c == "citations" else F.lit(values[c])).cast(kind).alias(c) for c, kind in SAID.items()]


def _written(asked: DataFrame, shown: DataFrame, provider: Provider) -> DataFrame:
    """What the provider writes to each question (question_id, question, mode) from its passages."""
    passage = F.struct("source", "document_id", "title", "chunk_index", "content", "heading", "page_start", "page_end")
    rows = asked.join(shown.groupBy("question_id").agg(F.array_sort(F.collect_list(passage)).alias("sources")), "question_id")  # at most 12 passages
    raw = pa.list_(pa.struct([("source", pa.float64()), ("quote", pa.string())]))
    kinds = {"string": pa.string(), "boolean": pa.bool_(), RAW: raw}

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part.slice(at, 64) for part in parts for at in range(0, part.num_rows, 64)):  # questions come with a dozen passages each
            made = [one(provider, r) for r in some.to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("question_id"), *(pa.array([m[c] for m in made], kinds[t]) for c, t in SAID.items())], names=["question_id", *SAID])

    return rows.mapInArrow(write, f"question_id {rows.schema['question_id'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in SAID.items()))


def one(provider: Provider, row: dict) -> dict:
    sources = [A.Source(s["source"], s["document_id"], s["title"] or "", s["chunk_index"], s["content"], s["heading"], s["page_start"], s["page_end"]) for s in row["sources"]]
    error = None
    try:
        made = with_retry(lambda: provider.generate(row["question"], sources, row["mode"]))
    except Exception as problem:  # noqa: BLE001 - a question that fails fails alone
        made, error = A.INSUFFICIENT, str(problem)[:1_000]
    return {"answer": made.text, "mode": row["mode"], "confidence": made.confidence, "insufficient": made.insufficient, "citations": [{"source": A.number(n), "quote": q} for n, q in made.citations], "error": error}
