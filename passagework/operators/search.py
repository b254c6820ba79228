"""Keyword, vector and hybrid search of many questions at once.

Questions are a table of known size, passages one of any. Passages are scored in an index of them, where a task keeps the
first of each list for every question; see index.py. Every ranking is a window by question with a total order (score, then id)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import ASKS_ABOUT_REFERENCES, REFERENCES_HEADING
from ..functions.text import normalize_for_match
from .index import PLACES, build, search


@dataclass(frozen=True)
class Tuning:
    """What a search can be tuned by."""

    k1: float = 1.2
    b: float = 0.75
    rrf_k: int = 60
    depth: int = 50
    top: int = 8
    references_penalty: float = 0.5
    least_score: float = 0.05
    least_coverage: float = 0.5


TUNING = Tuning()


def ranked(rows: DataFrame, by: str, *order: Column, at_most: int | None = None, name: str = "rank") -> DataFrame:
    """rows with their rank within `by`, only the first ones if told so."""
    numbered = rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return numbered if at_most is None else numbered.where(F.col(name) <= at_most)


def candidates(questions: DataFrame, question_key: str, question: Column, passages: DataFrame, key: str, text: Column, lists: dict[str, int], tuning: Tuning = TUNING, embedding: Column | None = None, embed: Callable | None = None) -> DataFrame:
    """question_key, key, vector_score, bm25, coverage of the first passages of each of the lists, by an index made for it; see index.search().

    embedding: stored vectors of the passages, with which those that embed() makes of the questions are compared; else hashed ones are made of both."""
    index = build(passages, key, text, vectors="vector_score" in lists, embedding=embedding)
    return search(index, questions, question_key, question, key, lists, tuning.k1, tuning.b, embed)


def grid_top(table: pa.Table, other: pa.Table, k: int) -> pa.Table:
    """Of queries and vectors of one cell: the k vectors with the best cosine for each query, never its own id."""

    def matrix(t: pa.Table) -> np.ndarray:
        x = t["vector"].combine_chunks()
        return np.array(x.flatten().to_numpy(), np.float64).reshape(len(x), -1)

    a, b = matrix(table), matrix(other)
    if a.shape[1] != b.shape[1]:
        raise ValueError("vectors differ in length")
    length = lambda x: np.sqrt((x * x).sum(axis=1))
    both = np.outer(length(a), length(b))
    score = np.round(np.clip(np.divide(a @ b.T, both, out=np.zeros_like(both), where=both > 0), -1, 1), PLACES) + 0.0
    query, ids = table["query_id"].to_numpy(), other["other_id"].to_numpy()
    score[query[:, None] == ids] = -2
    first = np.lexsort((np.broadcast_to(ids, score.shape), -score))[:, :k]
    kept = np.take_along_axis(score, first, 1)
    rows, places = np.nonzero(kept >= -1)
    return pa.table({"query_id": query[rows], "vec_id": ids[first[rows, places]], "score": kept[rows, places]})


#: Queries and vectors of one cell of the grid in which all of them meet.
GRID_QUERIES, GRID_VECTORS = 1_024, 8_192


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, same_label: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank of the nearest other vectors of each query; of its label only if told so.

    Null vectors have no part. Blocks of queries and of vectors meet in cells of bounded size, each a matrix product; within
    a label if told so, where a label with many vectors has many cells."""
    label = F.col("label") if same_label else F.lit(0)
    a = queries.where("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), label.alias("label"))
    b = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("vector"), label.alias("label"))
    if same_label:
        a, b = a.where("label IS NOT NULL"), b.where("label IS NOT NULL")
    tiles = lambda rows, size, name: rows.groupBy("label").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    cells = tiles(a, GRID_QUERIES, "rows").join(tiles(b, GRID_VECTORS, "columns"), "label")

    def dealt(rows: DataFrame, key: str, own: str, other: str, of_own: str, of_other: str) -> DataFrame:
        placed = rows.join(cells, "label").withColumn(own, F.pmod(F.xxhash64(key), F.col(of_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(of_other) - 1))).drop("rows", "columns")

    left, right = dealt(a, "query_id", "i", "j", "rows", "columns"), dealt(b, "other_id", "j", "i", "columns", "rows")
    met = left.toDF(*left.columns).groupBy("label", "i", "j").cogroup(right.toDF(*right.columns).groupBy("label", "i", "j"))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return grid_top(x, y, k)

    return ranked(met.applyInArrow(best, "query_id long, vec_id long, score double"), "query_id", F.desc("score"), F.col("vec_id"), at_most=k)


def fuse(rankings: list[DataFrame], by: str, key: str, tuning: Tuning = TUNING) -> DataFrame:
    """Reciprocal rank fusion of rankings (by, key, rank), as a share of the best score there can be."""
    everything = rankings[0].select(by, key, "rank")
    for other in rankings[1:]:
        everything = everything.unionByName(other.select(by, key, "rank"))
    return everything.groupBy(by, key).agg((F.sum(1.0 / (tuning.rrf_k + F.col("rank"))) / (len(rankings) / (tuning.rrf_k + 1.0))).alias("score"))


def both_lists(scores: DataFrame, by: str, key: str, tuning: Tuning = TUNING) -> DataFrame:
    """scores with `score`: the fused ranks in the vector list, with any score, and in the keyword list, of passages that share a term.

    Both ranks and all that follows by question come of one shuffle."""
    own = W.partitionBy(by)
    numbered = scores.withColumn("near", F.row_number().over(own.orderBy(F.desc("vector_score"), key))).withColumn("worded", F.row_number().over(own.orderBy(F.desc("bm25"), key)))
    share = lambda rank, here: F.when(here & (F.col(rank) <= tuning.depth), 1.0 / (tuning.rrf_k + F.col(rank)))
    near, worded = share("near", F.lit(True)), share("worded", F.col("bm25") > 0)
    both = (F.coalesce(near, F.lit(0.0)) + F.coalesce(worded, F.lit(0.0))) / (2 / (tuning.rrf_k + 1.0))
    return numbered.withColumn("score", both).where("score > 0").drop("near", "worded")


def about_references(heading: Column, question: Column | None) -> Column:
    """Whether a passage stands under a heading of references that the question doesn't ask about."""
    asks = F.lit(False) if question is None else F.coalesce(question.rlike("(?i)" + ASKS_ABOUT_REFERENCES), F.lit(False))
    return F.coalesce(heading.rlike("(?i)" + REFERENCES_HEADING), F.lit(False)) & ~asks


def hybrid(scores: DataFrame, by: str, key: str, heading: Column | None = None, question: Column | None = None, tuning: Tuning = TUNING) -> DataFrame:
    """The top passages of each question by fused vector and keyword ranks, from candidates of both lists.

    scores: by, key, vector_score, bm25, coverage. Passages under a heading of
    references count half, unless the question asks about references."""
    fused = both_lists(scores, by, key, tuning)
    if heading is not None:
        fused = fused.withColumn("score", F.when(about_references(heading, question), F.col("score") * tuning.references_penalty).otherwise(F.col("score")))
    return ranked(fused, by, F.desc("score"), F.desc("vector_score"), F.col(key), at_most=tuning.top)


def relevant(rows: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """Passages near enough by vector or by words; applied after the cut to the top."""
    return rows.where((F.col("vector_score") >= tuning.least_score) | (F.col("coverage") >= tuning.least_coverage))


def pair_scores(questions: DataFrame, question_key: str, question: Column, passages: DataFrame, key: str, text: Column, tuning: Tuning = TUNING, embedding: Column | None = None, embed: Callable | None = None) -> DataFrame:
    """question_key, key, vector_score, bm25, coverage of the passages that hybrid() can choose from."""
    return candidates(questions, question_key, question, passages, key, text, {"vector_score": tuning.depth, "bm25": tuning.depth}, tuning, embedding, embed)


#: Words of quotes that go to every task, so that a passage is read once; of more quotes, passages' words are joined with theirs.
QUOTE_WORDS = 4_096


def quotes_in(quotes: DataFrame, quote_key: str, quote: Column, passages: DataFrame, key: str, text: Column) -> DataFrame:
    """quote_key, key of every passage that holds a quote of three characters or more, both normalised.

    Pairs meet on one whole word of the quote's inside: such a word must also be a word of the passage. The longest is
    taken, being rare. Only passages with one of these words are carried on with their texts. Quotes of two words and less have no inside and meet on their first three
    characters."""
    asked = quotes.select(F.col(quote_key), normalize_for_match(quote).alias("quote")).where("length(quote) >= 3")
    inside = F.expr("filter(slice(split(quote, ' '), 2, greatest(0, size(split(quote, ' ')) - 2)), w -> length(w) > 0)")
    longest = F.expr("array_max(transform(inside, w -> struct(length(w) AS n, w AS w)))")["w"]
    keyed = asked.withColumn("inside", inside).withColumn("word", longest).drop("inside")
    held = passages.select(F.col(key), normalize_for_match(text).alias("content"))
    wanted = [r["word"] for r in keyed.where("word IS NOT NULL").select("word").distinct().limit(QUOTE_WORDS + 1).collect()]
    words = F.array_distinct(F.split("content", " "))
    if len(wanted) <= QUOTE_WORDS:
        some = F.array_intersect(words, F.lit(wanted) if wanted else F.array().cast("array<string>"))
        found = held.select(key, "content", F.explode(some).alias("word")).join(keyed, "word").where(F.contains("content", "quote")).select(quote_key, key)
    else:
        met = held.select(key, F.explode(words).alias("word")).join(keyed.where("word IS NOT NULL").select("word", quote_key), "word").select(quote_key, key)
        found = _confirmed(met, asked, quote_key, held, key)
    short = keyed.where("word IS NULL").select(quote_key, F.left("quote", F.lit(3)).alias("gram"))
    if short.isEmpty():
        return found
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("content") - 2)), lambda n: F.substring(F.col("content"), n, F.lit(3)))
    met = held.select(key, F.explode(F.array_distinct(grams)).alias("gram")).join(short, "gram").select(quote_key, key)
    return found.unionByName(_confirmed(met, asked, quote_key, held, key))


def _confirmed(met: DataFrame, asked: DataFrame, quote_key: str, held: DataFrame, key: str) -> DataFrame:
    """The pairs whose passage holds the whole quote."""
    return met.join(asked, quote_key).join(held, key).where(F.contains("content", "quote")).select(quote_key, key)
