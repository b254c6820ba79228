"""Answers made of the sources' own sentences, for all questions at once: terms, coverage and picks as rows and windows.

Only splitting and stemming run in Arrow batches, once for each source. All else is by question, whose sources are a dozen passages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import EXPLANATORY, FILLER_WORDS, FOCUS, NOT_FOUND, OVERVIEW_WORDS, QUANTITATIVE
from ..functions.plain import split_sentences, tokenize
from ..functions.text import word_count
from ..sources.tables import written
from .terms import tokens_of

# What a term counts where it stands, factors of filler and focus words, of the first sources, and the least shares of a question that a pick covers.
OWN, HEADING, BESIDE = 1.0, 0.6, 0.4
FILLER, FOCUSED, EARLIER = 0.3, 1.5, 0.08
LEAST, SURE, LEAST_NEW, LEAST_DIRECT = 0.5, 0.75, 0.15, 0.3
PICKS, SHORTEST, PLACES = 3, 3, 9


def sentence_terms(sources: DataFrame, key: str) -> DataFrame:
    """key, source, local, text, own, headed: the sentences of SHORTEST words and more of each source (key, source, heading, content), with their terms and those of the heading."""
    inner = sources.select(F.col(key).alias("key"), F.col("source").cast("int").alias("source"), "heading", "content")
    terms = pa.list_(pa.string())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part.slice(at, 256) for part in parts for at in range(0, part.num_rows, 256)):
            split = [[t for t in split_sentences(c or "") if len(t.split()) >= SHORTEST] for c in some.column("content").to_pylist()]
            headed = [list(dict.fromkeys(tokenize(h or ""))) for h in some.column("heading").to_pylist()]
            owner = pa.array([n for n, texts in enumerate(split) for _ in texts], pa.int64())
            flat = [t for texts in split for t in texts]
            columns = [pa.array([n for texts in split for n in range(len(texts))], pa.int32()), pa.array(flat, pa.string()), pa.array([list(dict.fromkeys(tokenize(t))) for t in flat], terms), pa.array([headed[n] for n in owner.to_pylist()], terms)]
            yield pa.RecordBatch.from_arrays([some.column("key").take(owner), some.column("source").take(owner), *columns], names=["key", "source", "local", "text", "own", "headed"])

    return inner.mapInArrow(run, f"key {inner.schema['key'].dataType.simpleString()}, source int, local int, text string, own array<string>, headed array<string>").withColumnRenamed("key", key)


def asked_terms(questions: DataFrame, key: str, question: str) -> DataFrame:
    """key, question, terms, focus: the distinct topic terms of each question, all of its terms where it has no topic, and the term that it asks for."""
    about = F.array(*[F.lit(t) for t in dict.fromkeys(tokenize(" ".join(OVERVIEW_WORDS)))])
    both = questions.select(F.struct(key, question, F.regexp_extract(question, "(?i)" + FOCUS, 1).alias("focused")).alias("key"), F.col(question).alias("text"))
    known = tokens_of(both, "key", F.col("text")).select("key.*", F.array_distinct("tokens").alias("tokens"))
    topic = F.array_except("tokens", about)
    stems = tokens_of(known.select(F.struct(key, question, F.when(F.size(topic) > 0, topic).otherwise(F.col("tokens")).alias("terms")).alias("key"), "focused"), "key", F.col("focused"))
    return stems.select(f"key.{key}", F.col(f"key.{question}").alias("question"), "key.terms", F.try_element_at("tokens", F.lit(1)).alias("focus"))


def _share(terms: Column, weights: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.try_element_at(weights, t))


def picked(questions: DataFrame, key: str, question: str, sources: DataFrame) -> DataFrame:
    """key, source, local, text, best, score: the sentences that answer each question, `best` the first of them, and that one's score.

    questions: key, question; sources: key, source (from 1), heading, content. A term of the question weighs by how few sentences hold it or stand under it, less if it is
    filler, more if the question asks for it; a sentence covers it by holding it, in part by its heading or a neighbour. The best sentence must cover LEAST; two more may follow that add
    LEAST_NEW, or the sentence after the best one if it has the number that is asked for or an explanation was. Questions without such a sentence have no rows."""
    asked = written(asked_terms(questions, key, question))
    within = W.partitionBy(key, "source").orderBy("local")
    none = F.array().cast("array<string>")
    beside = F.concat(F.coalesce(F.lag("own").over(within), none), F.coalesce(F.lead("own").over(within), none))
    met = sentence_terms(sources, key).withColumn("beside", beside).join(asked.select(key, "terms"), key)
    held = met.select(key, "source", "local", "text", *[F.array_intersect("terms", c).alias(c) for c in ("own", "headed", "beside")])
    first = F.row_number().over(W.partitionBy(key, "text").orderBy("source", "local"))
    sentences = written(held.withColumn("turn", first).where("turn = 1").drop("turn"))
    # weights of the terms
    holding = sentences.select(key, F.explode(F.array_union("own", "headed")).alias("term")).groupBy(key, "term").agg(F.count("*").alias("df"))
    total = sentences.groupBy(key).agg(F.count("*").alias("n"))
    terms = asked.select(key, "focus", F.posexplode("terms").alias("at", "term")).join(total, key).join(holding, [key, "term"], "left").withColumn("known", F.log(1 + F.col("n") / F.col("df")))
    filler = F.col("term").isin(*dict.fromkeys(tokenize(" ".join(FILLER_WORDS))))
    factor = F.when(filler, FILLER).when(F.col("term") == F.col("focus"), FOCUSED).otherwise(1.0)
    weighed = terms.withColumn("weight", F.coalesce("known", F.avg("known").over(W.partitionBy(key))) * factor).where("weight IS NOT NULL")  # null where no sentence has any term
    entries = F.array_sort(F.collect_list(F.struct("at", "term", "weight")))  # terms of one question
    by_question = weighed.groupBy(key).agg(entries.alias("e")).select(key, F.map_from_entries(F.transform("e", lambda e: F.struct(e["term"], e["weight"]))).alias("weights"), F.aggregate("e", F.lit(0.0), lambda s, e: s + e["weight"]).alias("total"))
    # coverage
    weights = F.col("weights")
    below = F.array_except(F.col("headed"), F.col("own"))
    partly = F.array_except(F.array_except(F.col("beside"), F.col("own")), F.col("headed"))
    covered = OWN * _share(F.col("own"), weights) + HEADING * _share(below, weights) + BESIDE * _share(partly, weights)
    scored = sentences.join(by_question, key).withColumn("score", F.round(covered / F.col("total"), PLACES)).withColumn("direct", F.round(_share(F.col("own"), weights) / F.col("total"), PLACES))
    merit = F.round(F.col("score") * (1 + EARLIER * F.greatest(F.lit(0), 3 - F.col("source"))), PLACES)
    here = W.partitionBy(key)
    order = F.struct(F.col("merit"), -F.col("source"), -F.col("local"))
    said = F.struct("source", "local", "text", "score", "own")
    rows = scored.withColumn("merit", merit).withColumn("best", F.max_by(said, order).over(here)).where(F.col("best.score") >= LEAST)
    same = lambda c: (F.col("source") == F.col(f"{c}.source")) & (F.col("local") == F.col(f"{c}.local"))
    rows = rows.withColumn("second", _next(rows, F.col("best.own"), ~same("best"), order, said, here))
    taken = F.array_union(F.col("best.own"), F.coalesce("second.own", none))
    rows = rows.withColumn("third", _next(rows, taken, ~same("best") & ~F.coalesce(same("second"), F.lit(False)), order, said, here))
    # the sentence after the best one
    chosen = same("best") | F.coalesce(same("second"), F.lit(False)) | F.coalesce(same("third"), F.lit(False))
    follows = (F.col("source") == F.col("best.source")) & (F.col("local") == F.col("best.local") + 1) & F.col("third").isNull() & (word_count(F.col("text")) >= 4)
    asks = lambda pattern: F.col("question").rlike("(?i)" + pattern)
    number = asks(QUANTITATIVE) & ~F.col("best.text").rlike("[0-9]") & F.col("text").rlike("[0-9]")
    told = rows.join(asked.select(key, "question"), key).where(chosen | (follows & (number | asks(EXPLANATORY))))
    return told.select(key, "source", "local", "text", same("best").alias("best"), F.col("best.score").alias("score"))


def _next(rows: DataFrame, covered: Column, open_: Column, order: Column, said: Column, here: W) -> Column:
    """Over the question: the sentence of most merit that covers enough, and enough that is not covered yet."""
    new = F.round(_share(F.array_except(F.col("own"), covered), F.col("weights")) / F.col("total"), PLACES)
    good = open_ & (F.col("score") > 0) & (new >= LEAST_NEW) & (F.col("direct") >= LEAST_DIRECT)
    return F.max_by(F.when(good, said), F.when(good, order)).over(here)


def answers(questions: DataFrame, key: str, question: str, sources: DataFrame) -> DataFrame:
    """key, answer, confidence, insufficient, citations (source, quote) of every question; without sentences that answer it, it is insufficient."""
    rows = picked(questions, key, question, sources).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source", "local", "text"))).alias("said"), F.max("score").alias("score"))  # PICKS of them at most
    cited = F.transform("said", lambda s: F.struct(s["source"].cast("double").alias("source"), s["text"].alias("quote")))
    text = F.array_join(F.transform("said", lambda s: F.concat(s["text"], F.lit(" ["), s["source"].cast("string"), F.lit("]"))), " ")
    made = questions.select(key).join(rows, key, "left")
    return made.select(
        key,
        F.coalesce(text, F.lit(NOT_FOUND)).alias("answer"),
        F.when(F.col("score") >= SURE, "high").when(F.col("score").isNotNull(), "medium").otherwise("low").alias("confidence"),
        F.col("said").isNull().alias("insufficient"),
        F.coalesce(cited, F.array().cast("array<struct<source:double, quote:string>>")).alias("citations"),
    )
