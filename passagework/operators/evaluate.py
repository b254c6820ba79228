"""Evaluation of answers against questions with known evidence: read a set, and count hits and right answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squash

EVAL_SET = "name string, documents array<string>, questions array<struct<q:string, evidence:array<string>, answer:array<string>, expectInsufficient:boolean>>"


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, evidence, answer, expect_insufficient of the sets in JSON files, in their order."""
    sets = spark.read.schema(EVAL_SET).json(path, multiLine=True)
    each = sets.select("name", F.posexplode("questions").alias("n", "e"))
    return each.select(
        F.concat_ws("#", "name", F.col("n").cast("string")).alias("question_id"),
        F.col("e.q").alias("question"),
        "e.evidence",
        "e.answer",
        F.coalesce("e.expectInsufficient", F.lit(False)).alias("expect_insufficient"),
    )


def contains_any(text: Column, phrases: Column) -> Column:
    """Whether a text holds one of the phrases, ignoring case and all but letters and digits."""
    return F.coalesce(F.exists(phrases, lambda p: squash(text).contains(squash(p))), F.lit(False))


def evaluate(questions: DataFrame, passages: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: n, retrievable, hit1, hit3, hitk, answered, and the last four as whole percents.

    questions: question_id, evidence, answer, expect_insufficient; passages: question_id, rank, content; answers:
    question_id, text, insufficient. A hit is the first passage that holds an evidence phrase. A question that can't be
    answered is right if the answer says so, any other if it holds an answer phrase and doesn't say so. Questions
    without answers are wrong."""
    asked = questions.select("question_id", "evidence", F.col("answer").alias("phrases"), "expect_insufficient")
    found = passages.join(asked.select("question_id", "evidence"), "question_id").where(contains_any(F.col("content"), F.col("evidence")))
    first = found.groupBy("question_id").agg(F.min("rank").alias("at"))
    rows = asked.join(first, "question_id", "left").join(answers.select("question_id", "text", "insufficient"), "question_id", "left")
    told = F.coalesce("insufficient", F.lit(True))
    right = F.when(F.col("expect_insufficient"), F.coalesce("insufficient", F.lit(False))).otherwise(~told & contains_any(F.coalesce("text", F.lit("")), F.col("phrases")))
    can = ~F.col("expect_insufficient")
    counts = rows.agg(
        F.count("*").alias("n"),
        F.count_if(can).alias("retrievable"),
        F.count_if(can & (F.col("at") == 1)).alias("hit1"),
        F.count_if(can & (F.col("at") <= 3)).alias("hit3"),
        F.count_if(can & F.col("at").isNotNull()).alias("hitk"),
        F.count_if(right).alias("answered"),
    )
    percent = lambda c, of: F.round(100 * F.col(c) / F.greatest(F.lit(1), F.col(of))).cast("int").alias(f"{c}_percent")
    return counts.select("*", *[percent(c, "retrievable") for c in ("hit1", "hit3", "hitk")], percent("answered", "n"))
