"""Tokens and term counts of a table of texts, made in Arrow batches where the texts are.

A word is stemmed once in a worker, not once for each place, which is several times as fast as a pass of
SQL lambdas over every word; functions.text.tokenize gives the same tokens as a column expression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plain import tokenize

SLICE = 512


def _made(rows: DataFrame, key: str, text: Column, of: Callable[[pa.RecordBatch, list[list[str]]], pa.RecordBatch], fields: str) -> DataFrame:
    inner = rows.select(F.col(key).alias("key"), text.alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, SLICE):
                some = part.slice(at, SLICE)
                yield of(some, [tokenize(t or "") for t in some.column("text").to_pylist()])

    return inner.mapInArrow(run, f"key {inner.schema['key'].dataType.simpleString()}, {fields}").withColumnRenamed("key", key)


def tokens_of(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, tokens: the stems of each text's words in order, then its compounds; none for null."""

    def of(part: pa.RecordBatch, tokens: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("key"), pa.array(tokens, pa.list_(pa.string()))], names=["key", "tokens"])

    return _made(rows, key, text, of, "tokens array<string>")


def term_counts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf, length: how often each term is in each text, and how many tokens that has. Counted inside the text, which needs no shuffle."""

    def of(part: pa.RecordBatch, tokens: list[list[str]]) -> pa.RecordBatch:
        counts = [Counter(some) for some in tokens]
        owner = pa.array([n for n, c in enumerate(counts) for _ in c], pa.int64())
        columns = [[t for c in counts for t in c], [n for c in counts for n in c.values()], [len(some) for some, c in zip(tokens, counts) for _ in c]]
        types = (pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([part.column("key").take(owner), *map(pa.array, columns, types)], names=["key", "term", "tf", "length"])

    return _made(rows, key, text, of, "term string, tf long, length long")


def frequencies(counts: DataFrame) -> DataFrame:
    """term, df, tf: in how many texts a term is, and how often in all."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
