"""Salient sentences of all documents at once, by marginal relevance in rounds of windows, and the passages that give a document's gist.

Everything is by document, so rows are dealt by document once and all windows and groups that follow stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import ABSTRACT_HEADING, BACK_MATTER_PATH, CONCLUSION_HEADING, INTRO_HEADING
from ..functions.text import is_mostly_table
from .terms import tokens_of

#: What relevance weighs against redundancy, sentences that are chosen, and places to which scores are rounded.
TRADE, KEY_POINTS, PLACES = 0.7, 5, 9


def salient(sentences: DataFrame, by: str, k: int = KEY_POINTS, trade: float = TRADE) -> DataFrame:
    """by, ord, turn of up to k sentences of each document, in the order in which they are chosen.

    sentences: by, ord, text, bonus. A sentence's relevance is its cosine with the document's TF-IDF centroid times its bonus;
    a round takes the one with the most relevance less redundancy, its greatest cosine with those taken before, and the first on a tie.
    Sentences without terms are never chosen, but count as sentences. A round is a window over the document, which the next one reuses."""
    keyed = sentences.select(F.struct(by, "ord", "bonus").alias("key"), "text")
    rows = tokens_of(keyed, "key", F.col("text")).select("key.*", "tokens").repartition(by)
    own, term = W.partitionBy(by), W.partitionBy(by, "term")
    counts = rows.withColumn("n", F.count("*").over(own)).select(by, "ord", "bonus", "n", F.explode("tokens").alias("term")).groupBy(by, "ord", "bonus", "n", "term").agg(F.count("*").alias("tf"))
    idf = F.log(1 + F.col("n") / F.count("*").over(term))
    weighed = counts.withColumn("idf", idf).withColumn("weight", F.col("tf") * F.col("idf")).withColumn("centre", F.sum("tf").over(term) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    made = weighed.groupBy(by, "ord", "bonus").agg(F.collect_list(F.struct("term", "weight")).alias("terms"), F.sum(F.col("weight") * F.col("centre")).alias("toward"), length.alias("length"))  # one sentence's terms
    unit = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), (t["weight"] / F.col("length")).alias("weight")))
    relevance = F.col("toward") / (F.col("length") * F.sqrt(F.sum("toward").over(own))) * F.col("bonus")  # a centroid's square is what its sentences add up to
    state = made.select(by, "ord", unit.alias("terms"), F.round(relevance, PLACES).alias("relevance")).withColumn("weights", F.map_from_entries("terms"))
    state = state.withColumn("nearest", F.lit(0.0)).withColumn("turn", F.lit(None).cast("int"))
    for turn in range(1, k + 1):
        gain = F.when(F.col("turn").isNull(), F.round(trade * F.col("relevance") - (1 - trade) * F.col("nearest"), PLACES))
        best = F.max_by(F.struct("ord", "weights"), F.struct(F.col("gain"), -F.col("ord"))).over(own)
        state = state.withColumn("gain", gain).withColumn("best", best)
        near = F.aggregate("terms", F.lit(0.0), lambda sum_, t: sum_ + t["weight"] * F.coalesce(F.try_element_at(F.col("best.weights"), t["term"]), F.lit(0.0)))
        taken = F.col("gain").isNotNull() & (F.col("ord") == F.col("best.ord"))
        state = state.withColumns({"nearest": F.greatest("nearest", near), "turn": F.coalesce("turn", F.when(taken, F.lit(turn)))}).drop("gain", "best")
    return state.where("turn IS NOT NULL").select(by, "ord", "turn")


def gist(passages: DataFrame, by: list[str], limit: Column) -> DataFrame:
    """The rows of passages (by, chunk_index, content, heading, points) that give the gist of each document, `limit` of them at most.

    First come the abstract, two passages of it, or the opening; then the introduction, the last conclusion, and the key points in their order;
    what room is left goes to prose at even distances. Back matter is left out. points: indexes of passages."""
    said = lambda pattern: F.coalesce(F.col("heading").rlike("(?i)" + pattern), F.lit(False))
    own = W.partitionBy(*by)
    order = own.orderBy("chunk_index")
    upto, onward = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    body = passages.where(~said(BACK_MATTER_PATH)).withColumns({"limit": limit, "abstract": said(ABSTRACT_HEADING), "intro": said(INTRO_HEADING), "conclusion": said(CONCLUSION_HEADING)})
    nth = lambda c, frame: F.when(F.col(c), F.count_if(F.col(c)).over(frame))
    abstract = nth("abstract", upto)
    opening = F.when((F.count_if("abstract").over(own) == 0) & (F.row_number().over(order) == 1), 1)
    point = F.array_position("points", F.col("chunk_index"))
    place = F.least(F.when(abstract <= 2, abstract), opening, F.when(nth("intro", upto) == 1, 3), F.when(nth("conclusion", onward) == 1, 4), F.when(point > 0, 4 + point))
    turn = F.row_number().over(own.orderBy(F.col("place").asc_nulls_last(), "chunk_index"))
    picked = body.withColumn("place", place).withColumn("picked", F.col("place").isNotNull() & (turn <= F.col("limit")))
    prose = picked.withColumn("prose", ~F.col("picked") & ~is_mostly_table(F.col("content"))).withColumn("room", F.col("limit") - F.count_if("picked").over(own))
    placed = prose.withColumn("at", F.count_if("prose").over(upto) - 1).withColumn("long", F.count_if("prose").over(own))
    step = F.col("long") / (F.col("room") + 1)
    even = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("room"))), lambda n: F.col("at") == F.least(F.col("long") - 1, F.floor(step * n + 0.5)))
    return placed.where(F.col("picked") | (F.col("prose") & (F.col("room") > 0) & even)).select(*passages.columns)
