"""Registered queries of summaries, overviews, citations and answers, each for all documents or questions at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import CUE_PHRASES
from ..functions.text import word_count
from ..operators import extract, salience
from ..operators.chunk import sentences_of_texts
from ..operators.citations import resolved
from ..sources import native
from . import queries as Q
from .details import LETTERS
from .queries import query, table, texts

HEADINGS = ("Abstract", "1 Introduction", "Paper › Conclusions", "References", None, "Method", "Results", "Discussion", None, "Appendix", "2 Data")


def chosen(values: tuple, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


@query
def salient_sentences(spark, d):
    """The five sentences of each document that say most of it and least again, of those of 8 to 45 words without a link."""
    sentences = sentences_of_texts(texts(spark, d), "doc_id").where(word_count(F.col("sentence")).between(8, 45) & ~F.col("sentence").rlike(r"https?://|^\[\d+\]"))
    bonus = F.when(F.col("sentence").rlike("(?i)" + CUE_PHRASES), 1.25).otherwise(1.0) * F.when(F.col("ord") == 0, 1.05).otherwise(1.0)
    found = salience.salient(sentences.select("doc_id", "ord", F.col("sentence").alias("text"), bonus.alias("bonus")), "doc_id")
    return found.join(sentences, ["doc_id", "ord"])


@query
def overview_picks(spark, d):
    """The blocks of each document that give its gist, under headings of all kinds, some of them tables, with two key points."""
    n = F.col("doc_id") + F.col("ord")
    blocks = Q.text_blocks(spark, d).withColumn("content", F.when((F.col("doc_id") * 7 + F.col("ord")) % 5 == 0, "Name: x; Price: 3").otherwise(F.col("text")))
    points = F.array((F.col("doc_id") % 5).cast("int"), (F.col("doc_id") % 3 + 4).cast("int"))
    passages = blocks.select("doc_id", F.col("ord").alias("chunk_index"), "content", chosen(HEADINGS, n).alias("heading"), points.alias("points"))
    return salience.gist(passages, ["doc_id"], chosen((8, 5, 4), F.col("doc_id"))).select("doc_id", "chunk_index", "heading")


def shown(spark, d, most: int):
    """Each benchmark text with the first documents found for it, as sources of an answer."""
    top = Q.bm25_topk(spark, d).where(F.col("rank") <= most)
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("heading"))
    return top.join(docs, "doc_id").select(F.col("item_id").alias("question_id"), F.col("rank").alias("source"), F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "heading", "content")


@query
def resolved_citations(spark, d):
    """Quotes of each benchmark text as citations of the documents found for it: of sources that are and that are not, alike and verbatim or not."""
    text = F.col("text")
    first = F.left(text, F.lit(40))
    raw = ((1, first), (1, F.concat(F.lit("  "), F.translate(first, LETTERS, LETTERS.upper()), F.lit(" "))), (2, F.left(text, F.lit(60))), (2.5, first), (9, first), (3, F.left(text, F.lit(2))), (4, F.substring(text, 10, 30)), (0, first))
    cited = F.array(*[F.struct(F.lit(float(n)).alias("source"), q.alias("quote")) for n, q in raw])
    found = resolved(table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), cited.alias("citations")), shown(spark, d, 4))
    return found.select(F.col("question_id").alias("item_id"), "ord", "source", F.col("document_id").alias("doc_id"), "quote", "verified")


@query
def extracted_answers(spark, d):
    """Questions made of the benchmark texts, answered by sentences of the first three documents found for each."""
    asked = table(spark, d, "benchmark").select("item_id", F.concat(chosen(("", "How many ", "Explain why "), F.col("item_id")), "text").alias("question"))
    made = extract.answers(asked, "item_id", "question", shown(spark, d, 3).withColumnRenamed("question_id", "item_id"))
    return made.select("item_id", "answer", "confidence", "insufficient", F.size("citations").alias("n_citations"))


def as_markdown(spark, d):
    """Documents with their lines as Markdown: headings of both styles, paragraphs with marks, items, tables and fences in turn."""
    lines = texts(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    c = F.trim(F.left(F.trim(F.regexp_replace(F.regexp_replace("raw", r"[^\p{L}\p{N} ]+", ""), " +", " ")), F.lit(60)))
    line = lines.select("doc_id", "i", F.when(c == "", "x").otherwise(c).alias("c"), ((F.col("i") + F.col("doc_id")) % 13).alias("kind"))
    c, word = F.col("c"), F.split_part("c", F.lit(" "), F.lit(1))
    made = {0: F.concat(F.lit("# "), c, F.lit(" ##")), 2: F.concat(F.lit("**"), c, F.lit("** and `code`")), 3: F.lit(""), 5: F.lit("-----"), 6: F.concat(F.lit("- ["), c, F.lit("](http://x)")), 7: F.lit("* item"), 8: F.lit("| Key | Word |"), 9: F.lit("|---|---|"), 10: F.concat(F.lit("| "), F.col("i").cast("string"), F.lit(" | "), word, F.lit(" |")), 11: F.lit("```")}
    chosen_ = c
    for kind, text in made.items():
        chosen_ = F.when(F.col("kind") == kind, text).otherwise(chosen_)
    each = F.array_sort(F.collect_list(F.struct("i", chosen_.alias("line"))))  # lines of one document
    return line.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("markdown"))


@query
def markdown_blocks(spark, d):
    """The blocks of these texts: running fences, headings above underlines, tables and paragraphs as sessions of lines."""
    return native.markdown_blocks(as_markdown(spark, d), "doc_id", F.col("markdown"))
