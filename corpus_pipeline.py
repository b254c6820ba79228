"""A training corpus from raw documents: language, near-duplicates, personal data, source weights, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import bpe, langid, minhash, mixing, pii
from passagework.llm.common import shared_dir

#: A text that has less of its n-grams in common with every landmark is in no learned language: on sf0.1 held-out texts
#: and excerpts of one word and more have 0.5 at least, lines in other scripts at most 0.25. Texts in other languages
#: of the same script are not told apart by this and stay.
LEAST_KNOWN = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from docs; texts without letters and those of no learned language go."""
    said = langid.identify(docs, docs.columns, ("__held_out", "__lang", "__score", "__known"))
    return said.where((F.col("__lang") != langid.UNDETERMINED) & (F.col("__known") >= LEAST_KNOWN)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), that with the smallest id.

    Rows are judged one by one, also where some share an id. Rows that repeat id and text are copies
    too, and one of them stays; rows with a null id can't be told apart and all stay."""
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    found = minhash.near_duplicates(docs.select("doc_id", "text", digest.alias("__text")), percent=80, also=("__text",))
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("__text").alias("__gone")).distinct()
    left = docs.join(dropped, (docs["doc_id"] == dropped["__id"]) & (digest == dropped["__gone"]), "left_anti")
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left  # nothing repeats, and the texts need not be shuffled to see it
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew."""
    return pii.redact(docs).withColumns({c: F.length("text").cast(t) for c, t in docs.dtypes if c == "n_chars"})


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them; one that is taken twice is there twice."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded bytes of every document."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL expresses neither the trained stages nor the encoding; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
