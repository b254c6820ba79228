"""Citations as rows: those of sources that exist, each quote of a source once, checked against its passage, numbered anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_for_match

CITED = "array<struct<source:double, quote:string>>"


def resolved(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """question_id, ord, source, document_id, chunk_index, quote, verified.

    raw: question_id, citations (source, quote); sources: question_id, source (from 1), document_id, chunk_index, content.
    A source that is no whole number, or is not among the question's, has no row. Of quotes of one source that are alike
    once normalised, the first stays; one of three characters and more that stands in the passage is verified."""
    cited = raw.select("question_id", F.posexplode(F.col("citations").cast(CITED)).alias("pos", "c"))
    quote = F.regexp_replace(F.coalesce("c.quote", F.lit("")), r"^\s+|\s+$", "")
    whole = cited.where("c.source = floor(c.source) AND abs(c.source) < 1e9").select("question_id", "pos", F.col("c.source").cast("int").alias("source"), quote.alias("quote"))
    held = sources.select("question_id", F.col("source").cast("int").alias("source"), "document_id", "chunk_index", "content")
    met = whole.join(held, ["question_id", "source"]).withColumn("plain", normalize_for_match(F.col("quote")))
    verified = F.coalesce((F.length("plain") >= 3) & normalize_for_match(F.col("content")).contains(F.col("plain")), F.lit(False))
    turn = F.row_number().over(W.partitionBy("question_id", "source", "plain").orderBy("pos"))
    first = met.withColumn("verified", verified).drop("content").withColumn("turn", turn).where("turn = 1")
    ord_ = F.row_number().over(W.partitionBy("question_id").orderBy("pos")) - 1  # an answer's citations
    return first.select("question_id", ord_.cast("int").alias("ord"), "source", "document_id", "chunk_index", "quote", "verified")
