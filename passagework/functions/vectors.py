"""Vector functions: dense ones over arrays, and sparse hashed embeddings as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plain import tokenize

BUCKETS, BIGRAM_WEIGHT = 512, 0.5


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order; unequal lengths are an error."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    checked = F.when(F.size(a) == F.size(b), products).otherwise(F.raise_error(F.lit("vectors differ in length")))
    return F.aggregate(checked, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit vector in single precision; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)).cast("float"))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity within [-1, 1]; 0 if either vector is zero."""
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(a, b), both), F.lit(0.0))))


def bytes_to_vector(data: Column) -> Column:
    """Little-endian 32-bit floats of a binary column as an array of float; an error if the length is no multiple of 4."""

    @F.pandas_udf("array<float>")
    def decoded(column: pd.Series) -> pd.Series:
        sizes = column.str.len().fillna(0).astype(int)
        if (sizes % 4).any():
            raise ValueError("a vector's bytes are no multiple of 4")
        numbers = np.frombuffer(b"".join(column.dropna()), "<f4")
        cut = np.split(numbers, np.cumsum(sizes.to_numpy() // 4)[:-1]) if len(column) else []
        return pd.Series(cut, dtype=object).where(column.notna().to_numpy(), None)

    return decoded(data)


def vector_to_bytes(vector: Column) -> Column:
    """An array of numbers as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def encoded(column: pd.Series) -> pd.Series:
        sizes = np.array([0 if v is None else 4 * len(v) for v in column], int)
        ends = np.cumsum(sizes)
        data = np.concatenate([np.zeros(0), *column.dropna()]).astype("<f4").tobytes()
        return pd.Series([data[e - n : e] for e, n in zip(ends, sizes)], dtype=object).where(column.notna().to_numpy(), None)

    return encoded(vector)


def fnv_buckets(terms: list[str]) -> np.ndarray:
    """Buckets of the terms by 32-bit FNV-1a over code points: one step for the n-th characters of all terms at once."""
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    codes = np.frombuffer("".join(terms).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(terms) else size
    order = np.argsort(-size, kind="stable")
    hashes = np.full(len(terms), 2_166_136_261, np.uint64)
    left = int((size > 0).sum())
    for n in range(int(size.max(initial=0))):
        while left and size[order[left - 1]] <= n:
            left -= 1
        rows = order[:left]
        hashes[rows] = (hashes[rows] ^ codes[start[rows] + n]) * np.uint64(16_777_619) % np.uint64(1 << 32)
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def bucket_sums(tokens: list[list[str]]) -> np.ndarray:
    """Sums by bucket of token lists, one row each: 1 a token and half a pair of neighbours."""
    pairs = [[f"{a}_{b}" for a, b in zip(some, some[1:])] for some in tokens]
    sizes = np.array([(len(a), len(b)) for a, b in zip(tokens, pairs)], np.int64).reshape(-1, 2)
    at = fnv_buckets([t for a, b in zip(tokens, pairs) for t in (*a, *b)])
    owner = np.repeat(np.arange(len(tokens)), sizes.sum(axis=1))
    weight = np.repeat(np.tile([1.0, BIGRAM_WEIGHT], len(tokens)), sizes.ravel())
    return np.bincount(owner * BUCKETS + at, weight, len(tokens) * BUCKETS).reshape(len(tokens), BUCKETS)


def unit(sums: np.ndarray) -> np.ndarray:
    """Rows brought to length 1; zero rows stay."""
    return sums / np.sqrt(np.maximum((sums * sums).sum(axis=1, keepdims=True), 1e-300))


def embedded(tokens: list[list[str]]) -> np.ndarray:
    """Hashed embeddings of token lists, one row each, of unit length; zero without tokens."""
    return unit(bucket_sums(tokens))


def _sparse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (whole.slice(at, 512) for whole in parts for at in range(0, whole.num_rows, 512)):
        made = embedded([tokenize(t or "") for t in part.column("text").to_pylist()])
        rows, buckets = np.nonzero(made)
        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows)), pa.array(buckets.astype(np.int32)), pa.array(made[rows, buckets])], names=["key", "bucket", "weight"])


def hashed_embedding(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, bucket, weight: sparse unit vectors of hashed tokens, 1 a token and half a pair of neighbours.

    Texts without tokens have no rows. A row's vector is made where the row is, in Arrow
    batches: hashing character by character in SQL took twenty times as long, and summing
    buckets there two shuffles."""
    inner = rows.select(F.col(key).alias("key"), text.alias("text"))
    return inner.mapInArrow(_sparse, f"key {inner.schema['key'].dataType.simpleString()}, bucket int, weight double").withColumnRenamed("key", key)
