"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers. An index block holds some thousand rows as
bitmaps: for each dimension, one bitmap per binary digit of the value above
the block's minimum. A query's integer weights, in signed binary digits, pick
shifted bitmaps (complemented for negative digits); carry-save adders, which
are a few AND, OR and XOR over whole bitmaps, add them into the bitmaps of the
score. The best rows are then selected from the most significant slice
downward; when the last slice leaves more rows than wanted, these tie, and the
smallest ids are taken.

Blocks of rows and batches of queries meet in a grid of cells of fixed size, one
task each; a cell returns k rows a query, and the best k of those are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

BLOCK_ROWS, BATCH_ROWS = 16_384, 8_192
#: Partitions of the grid at most; of more cells, a task takes several, one after the other.
MOST_PARTITIONS = 4_096
#: Quantised components end here: the difference of two still is a 64-bit number. Scores end at those of 64 bits.
LARGEST, MOST_SCORE = float(2**62 - 512), 2**63 - 1


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, within LARGEST; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))  # NaN is not less
    whole = lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x.cast("double") * 256))).cast("long")
    return F.when(finite, F.transform(vector, whole))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Integer lists as rows of a matrix, shorter ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
    return out


class Block:
    """Bit slices of up to some thousand rows in order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.least = values.min(axis=0) if len(ids) else np.zeros(values.shape[1], np.int64)
        above = values - self.least
        words = -(-len(ids) // 64)
        slices, self.dim, self.digit = [], [], []
        for d in range(values.shape[1]):
            for b in range(int(above[:, d].max(initial=0)).bit_length()):
                slices.append(bitmap((above[:, d] >> b) & 1, words))
                self.dim.append(d)
                self.digit.append(b)
        self.slices = np.array(slices, np.uint64).reshape(len(slices), words)
        self.dim, self.digit = np.array(self.dim, np.int64), np.array(self.digit, np.int64)
        self.rows = bitmap(np.ones(len(ids), np.int64), words)

    def best(self, weights: np.ndarray, k: int, but: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k rows with the largest inner products, ties to smaller ids, without the row of id `but`."""
        weights = np.resize(np.append(weights, np.zeros(max(0, len(self.least) - len(weights)), np.int64)), len(self.least))
        score, constant = self.added(weights)
        left = self.rows.copy()
        if but is not None:
            for at in range(*np.searchsorted(self.ids, [but, but + 1])):
                left[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        taken = np.zeros_like(left)
        have = 0
        for plane in reversed(score):
            ones = left & plane
            n = int(np.bitwise_count(ones).sum())
            if have + n >= k:
                left = ones
            else:
                taken, have, left = taken | ones, have + n, left & ~plane
        rows = np.append(members(taken), members(left)[: k - have])
        planes = [(plane[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1) for plane in score]
        found = [(sum(int(p[i]) << b for b, p in enumerate(planes)) + constant, int(self.ids[r])) for i, r in enumerate(rows)]
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def added(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the inner product, least significant first, and what must be added to it."""
        constant = sum(w * x for w, x in zip(weights.tolist(), self.least.tolist()))  # in integers of any length
        piles: dict[int, list[np.ndarray]] = {}
        for shift, digits in enumerate(signed_digits(weights)):
            sign = digits[self.dim]
            for b in np.unique(self.digit[sign != 0]):
                rows = np.flatnonzero((sign != 0) & (self.digit == b))
                negative = sign[rows] < 0
                flip = np.where(negative, ~np.uint64(0), np.uint64(0))[:, None]
                piles.setdefault(shift + int(b), []).append(self.slices[rows] ^ flip)
                constant -= int(negative.sum()) << (shift + int(b))
        score, place = [], 0
        while piles:
            pile = piles.pop(place, None)
            if pile is None:
                score.append(np.zeros_like(self.rows))
                place += 1
                continue
            stack = np.concatenate(pile)
            while len(stack) > 1:
                n = max(1, len(stack) // 3)
                if len(stack) > 2:  # full adders: three bitmaps of a place become its sum and a carry
                    a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                    half = a ^ b
                    carry = (a & b) | (half & c)
                    stack = np.concatenate([half ^ c, stack[3 * n :]])
                else:
                    carry, stack = stack[:1] & stack[1:], stack[:1] ^ stack[1:]
                piles.setdefault(place + 1, []).append(carry)
            score.append(stack[0])
            place += 1
        return score, constant

    def dump(self) -> dict[str, bytes | int]:
        shape = np.array([len(self.least), len(self.dim), len(self.rows)], np.int64)
        parts = (shape, self.ids, self.least, self.dim, self.digit)
        return {"head": b"".join(x.astype(np.int64).tobytes() for x in parts), "slices": self.slices.tobytes(), "rows": self.rows.tobytes()}

    @classmethod
    def load(cls, head: bytes, slices: bytes, rows: bytes) -> Block:
        self = cls.__new__(cls)
        numbers = np.frombuffer(head, np.int64)
        dims, n, words = numbers[:3]
        self.ids, self.least, self.dim, self.digit = np.split(numbers[3:], [len(numbers) - 3 - dims - 2 * n, len(numbers) - 3 - 2 * n, len(numbers) - 3 - n])
        self.slices = np.frombuffer(slices, np.uint64).reshape(n, words)
        self.rows = np.frombuffer(rows, np.uint64)
        return self


def bitmap(bits: np.ndarray, words: int) -> np.ndarray:
    packed = np.zeros(words * 8, np.uint8)
    some = np.packbits(bits.astype(np.uint8), bitorder="little")
    packed[: len(some)] = some
    return packed.view(np.uint64)


def members(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))


def signed_digits(weights: np.ndarray) -> Iterator[np.ndarray]:
    """Digits -1, 0, 1 of the weights, least significant first, no two neighbours both set."""
    rest = weights.copy()
    while rest.any():
        digit = np.where(rest & 1, 2 - (rest & 3), 0)
        yield digit
        rest = (rest - digit) >> 1


def _block(table: pa.Table) -> pa.Table:
    block = Block(table["vec_id"].to_numpy(), matrix(table["value"].combine_chunks()))
    return pa.table({"block": table["block"][:1], **{k: pa.array([v], pa.binary()) for k, v in block.dump().items()}})


def _batch(table: pa.Table) -> pa.Table:
    values = matrix(table["value"].combine_chunks())
    return pa.table({"batch": table["batch"][:1], "turns": pa.array([table["turn"].to_numpy().tobytes()], pa.binary()), "query_ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), "weights": pa.array([values.tobytes()], pa.binary())})


def grid(rows: int, queries: int, cores: int) -> tuple[int, int, int]:
    """Blocks of rows, batches of queries, and partitions in which they meet: two cells for each core at least, and each block goes to as many cells as there are batches."""
    blocks = max(1, -(-rows // BLOCK_ROWS))
    batches = max(1, -(-queries // BATCH_ROWS), min(queries, -(-2 * cores // blocks)))
    return blocks, batches, min(blocks * batches, MOST_PARTITIONS)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner products of floor(256 x), for each query.

    vectors has vec_id and embedding. Queries are the rows whose id is
    divisible by `every`; each is compared with every row but those of its own id. Rows with a
    null id, and vectors that are null or hold null or non-finite components, take
    no part. Rows that repeat an id are candidates each, and each different vector of a repeated query id
    is a query. Components of 2**54 and more count as that, and scores beyond 64 bits as the largest of these, as floor(256 x) and its sums can't
    be told in 64 bits there. Of vectors of
    unequal length, the common leading components are multiplied; an empty
    vector scores 0. Equal scores go to the smaller vec_id; with fewer than k
    rows all are returned, and an empty table gives an empty result. Other
    columns are ignored."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("value")).where("vec_id IS NOT NULL AND value IS NOT NULL")
    # rows are dealt by their places, so that one id with many rows is dealt like many; the staged table fixes the places
    rows = staged(usable.withColumn("place", F.xxhash64(F.monotonically_increasing_id())))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("value").alias("turn"), "value").distinct()
    blocks, batches, n = grid(rows.count(), asked.count(), vectors.sparkSession.sparkContext.defaultParallelism)
    index = staged(
        rows.withColumn("block", F.pmod("place", F.lit(blocks)).cast("int"))
        .groupBy("block")
        .applyInArrow(_block, "block int, head binary, slices binary, rows binary")
    )
    queries = (
        asked.withColumn("batch", F.pmod(F.xxhash64("vec_id", "turn"), F.lit(batches)).cast("int"))
        .groupBy("batch")
        .applyInArrow(_batch, "batch int, turns binary, query_ids binary, weights binary")
    )

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                cell = {c: part.column(c)[row].as_py() for c in ("head", "slices", "rows", "turns", "query_ids", "weights")}
                block = Block.load(cell["head"], cell["slices"], cell["rows"])
                ids, turns = np.frombuffer(cell["query_ids"], np.int64), np.frombuffer(cell["turns"], np.int64)
                weights = np.frombuffer(cell["weights"], np.int64).reshape(len(ids), -1)
                found = [(int(q), int(t), i, max(-MOST_SCORE, min(MOST_SCORE, s))) for q, t, w in zip(ids, turns, weights) for s, i in block.best(w, k, int(q))]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], names=["query_id", "turn", "vec_id", "score"])

    key = ["block", "batch"]
    left = index.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).repartition(n, *key)
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(n, *key)
    best = left.join(right.hint("shuffle_hash"), key).mapInArrow(cells, "query_id long, turn long, vec_id long, score long")  # hashes one batch of queries
    rank = F.row_number().over(W.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
