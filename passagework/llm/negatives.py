"""Hard-negative mining: exact inner products of anchors and candidates by Strassen's multiplication, kept in mergeable heaps.

Candidates are packed where they lie into tiles of bounded size, int64 matrices. Batches of anchors meet the tiles
in a grid of cells; a task holds one batch and streams the tiles past it. Each meeting of a strip of anchors and a
tile is one recursive product, zero rows and columns padding odd sides. Additions modulo 2**64 are exact whenever the
score itself fits into 64 bits; rows too long for that are multiplied again in integers of any length.

The first reading of the tiles keeps a heap of positives for each anchor, the second one a heap of negatives for the
window below each positive's score. A task gives each heap once, whatever it has read, and heaps
of the same owner merge by score and id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bitslice import MOST_SCORE, matrix, quantised
from .common import small_batches, staged

#: Sides of matrices from which on they are multiplied directly.
LEAF = 8
#: Anchors of a batch and of a strip of it, candidates of a tile at most and bytes of its matrix, and candidates that one cell streams.
BATCH_ROWS, STRIP_ROWS, TILE_ROWS, TILE_BYTES, CELL_ROWS = 8_192, 512, 2_048, 1 << 20, 131_072
#: A task takes several cells where the grid has more than this.
MOST_PARTITIONS = 4_096
NONE = -(2**63)  # stands for no score; scores end at -MOST_SCORE


def even(x: np.ndarray) -> np.ndarray:
    """x with a row and a column of zeros more where its sides are odd."""
    out = np.zeros([n + n % 2 for n in x.shape], x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b by seven products of half the size."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a, b = even(a), even(b)
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1, p2, p3, p4 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11), strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5, p6, p7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    c = np.empty((2 * h, 2 * j), a.dtype)
    c[:h, :j], c[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    c[h:, :j], c[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return c[:m, :n]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, within 64 bits; of vectors of unequal length, of their common leading components."""
    k = min(a.shape[1], b.shape[1])
    a, b = a[:, :k], b[:, :k]
    score = strassen(a, b.T)
    # two vectors shorter than 2**31 have a product below 2**62
    long_a, long_b = (np.flatnonzero((x.astype(float) ** 2).sum(axis=1) > 2.0**62) for x in (a, b))
    for rows, columns in ((long_a, np.arange(len(b))), (np.setdiff1d(np.arange(len(a)), long_a), long_b)):
        if len(rows) and len(columns):
            exact = strassen(a[rows].astype(object), b[columns].T.astype(object))
            score[np.ix_(rows, columns)] = np.minimum(np.maximum(exact, -MOST_SCORE), MOST_SCORE).astype(np.int64)
    return score


class Heaps:
    """For each of some owners the best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, owners: int, size: int) -> None:
        self.score, self.id = np.full((owners, size), NONE), np.zeros((owners, size), np.int64)

    def offer(self, start: int, score: np.ndarray, ids: np.ndarray) -> None:
        """The owners from `start` on are offered the ids with their rows of scores, but for those with NONE."""
        size = self.score.shape[1]
        least = self.score[start : start + len(score), -1]
        good = (score >= least[:, None]) & (score != NONE)
        if good.sum() > 2 * size * len(score) and score.shape[1] > size:
            least = np.maximum(least, np.partition(score, -size, axis=1)[:, -size])
            good &= score >= least[:, None]
        rows, columns = np.nonzero(good)
        self.merge(start + rows, score[rows, columns], ids[columns])

    def merge(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Entries of other heaps, or new ones."""
        size, touched = self.score.shape[1], np.unique(owner)
        owner = np.concatenate([np.repeat(touched, size), owner])
        score, ids = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((ids, ~score, owner))  # ~ turns the order around and stays within 64 bits
        owner, score, ids = owner[order], score[order], ids[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < size
        self.score[owner[kept], place[kept]], self.id[owner[kept], place[kept]] = score[kept], ids[kept]

    def every(self, step: int, place: int) -> Heaps:
        """The heaps at one place of each `step`, not a copy."""
        some = Heaps.__new__(Heaps)
        some.score, some.id = self.score[place::step], self.id[place::step]
        return some

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, score and id of all."""
        owner, place = np.nonzero(self.score != NONE)
        return owner, self.score[owner, place], self.id[owner, place]


def window(positives: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest score of negatives, in hundredths `low` and `high` of each positive score."""
    exact = positives.astype(object)
    least, most = -((-low * exact) // 100), (high * exact) // 100
    return tuple(np.minimum(np.maximum(x, -MOST_SCORE), MOST_SCORE).astype(np.int64) for x in (least, most))


COLUMNS = {"ids": np.int64, "labels": np.int64, "turns": np.int64, "values": np.int64, "positives": np.int64}
PACKED = ", ".join(f"{c} binary" for c in COLUMNS)


def packed(ids: np.ndarray, labels: np.ndarray, values: np.ndarray, turns: np.ndarray | None = None, positives: np.ndarray | None = None) -> dict[str, bytes]:
    some = {"ids": ids, "labels": labels, "values": values, "turns": turns, "positives": positives}
    return {c: b"" if some[c] is None else np.ascontiguousarray(some[c], kind).tobytes() for c, kind in COLUMNS.items()}


def unpacked(row: dict) -> dict[str, np.ndarray]:
    some = {c: np.frombuffer(row[c], kind) for c, kind in COLUMNS.items()}
    n = len(some["ids"])
    return some | {"values": some["values"].reshape(n, -1), "positives": some["positives"].reshape(n, -1)}


def tiles(rows: DataFrame) -> DataFrame:
    """n, tile and the packed columns of rows (vec_id, label, value), packed where they lie."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = 0
            while at < part.num_rows:
                some = part.slice(at, TILE_ROWS)
                sizes = np.diff(some.column("value").offsets.to_numpy())
                widths = np.maximum.accumulate(sizes) * np.arange(1, len(sizes) + 1) * 8  # bytes of the first rows as a matrix
                n = max(1, int(np.searchsorted(widths, TILE_BYTES, "right")))
                some, at = some.slice(0, n), at + n
                made = packed(*(some.column(c).to_numpy() for c in ("vec_id", "label")), matrix(some.column("value")))
                yield pa.RecordBatch.from_pylist([{"n": some.num_rows} | made], schema=pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in COLUMNS)]))

    made = small_batches(rows).mapInArrow(pack, f"n long, {PACKED}")
    return staged(made.withColumn("tile", F.xxhash64(F.monotonically_increasing_id())))


def batches_of(anchors: DataFrame, batches: int) -> DataFrame:
    """batch and the packed columns of anchors (vec_id, turn, label, value, and positives where they are known)."""
    known = "positives" in anchors.columns

    def pack(table: pa.Table) -> pa.Table:
        own = {c: table[c].to_numpy() for c in ("vec_id", "label", "turn")}
        made = packed(own["vec_id"], own["label"], matrix(table["value"].combine_chunks()), own["turn"], matrix(table["positives"].combine_chunks()) if known else None)
        return pa.table({"batch": table["batch"][:1], **{c: pa.array([v], pa.binary()) for c, v in made.items()}})

    return anchors.withColumn("batch", F.pmod(F.xxhash64("vec_id", "turn"), F.lit(batches)).cast("int")).groupBy("batch").applyInArrow(pack, f"batch int, {PACKED}")


Heap = Callable[[dict], Heaps]
Offer = Callable[[dict, Heaps, int, dict, np.ndarray], None]


def met(anchors: DataFrame, candidates: DataFrame, batches: int, parts: int, start: Heap, offer: Offer) -> DataFrame:
    """anchor, turn, place, id, score: the heaps of all cells.

    start makes a batch's heaps, the same number for each anchor; offer gives them the scores of a strip of anchors and a tile."""
    left = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), F.pmod("tile", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("what"), *COLUMNS)
    right = anchors.select("batch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("what"), *COLUMNS)
    cell = (F.col("batch") * parts + F.col("part")).cast("long")
    both = right.unionByName(left).withColumn("cell", cell).drop("batch", "part")
    n = min(batches * parts, MOST_PARTITIONS)
    dealt = both.repartitionById(n, F.pmod("cell", F.lit(n)).cast("int")).sortWithinPartitions("cell", "what")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heaps = None, None
        for part in rows:
            for at in range(part.num_rows):
                row = {c: part.column(c)[at].as_py() for c in ("cell", "what", *COLUMNS)}
                some = unpacked(row)
                if row["what"] == 0:
                    if heaps is not None:
                        yield out(now, heaps)
                    now, heaps = some, start(some)
                elif heaps is not None:
                    for first in range(0, len(now["ids"]), STRIP_ROWS):
                        strip = {c: x[first : first + STRIP_ROWS] for c, x in now.items()}
                        score = products(strip["values"], some["values"])
                        offer(strip, heaps, first, some, np.where(strip["ids"][:, None] == some["ids"], NONE, score))
        if heaps is not None:
            yield out(now, heaps)

    def out(of: dict, heaps: Heaps) -> pa.RecordBatch:
        owner, score, ids = heaps.entries()
        each = max(1, len(heaps.score) // max(1, len(of["ids"])))
        anchor = owner // each
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (of["ids"][anchor], of["turns"][anchor], owner % each, ids, score)], names=["anchor", "turn", "place", "id", "score"])

    return dealt.select("cell", "what", *COLUMNS).mapInArrow(run, "anchor long, turn long, place long, id long, score long")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows of vectors (vec_id, embedding, label).

    Anchors are the rows whose id is divisible by `every`. An anchor's positives are its first rows of the same label by the
    integer inner product of floor(256 x), its negatives for one positive the first rows of other labels whose score lies between
    `low` and `high` hundredths of the positive's, both included; a negative score leaves no room between them. Ties go to the smaller id; of fewer rows all are returned.
    Rows with a null id or label, or a vector that is null or has a null or non-finite component, take no part. Labels are whole numbers.
    Rows that share an id never meet. Of rows that repeat an anchor's id, each different label and vector is an anchor; otherwise each row counts for itself.
    Components and scores end at 64 bits, as in top_k(). An empty table gives an empty result; other columns are ignored."""
    columns = (F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("value"))
    usable = vectors.select(*columns).where("vec_id IS NOT NULL AND label IS NOT NULL AND value IS NOT NULL")
    asked = staged(usable.where(F.col("vec_id") % every == 0).distinct().withColumn("turn", F.xxhash64("label", "value")))
    candidates = tiles(usable)
    n, long = asked.count(), candidates.agg(F.sum("n")).first()[0] or 0
    batches = -(-n // BATCH_ROWS) or 1
    wide = -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // batches)  # few batches are dealt to all cores
    parts = max(1, -(-long // CELL_ROWS), wide)

    def first_positives(strip: dict, heaps: Heaps, first: int, tile: dict, score: np.ndarray) -> None:
        heaps.offer(first, np.where(strip["labels"][:, None] == tile["labels"], score, NONE), tile["ids"])

    def in_windows(strip: dict, heaps: Heaps, first: int, tile: dict, score: np.ndarray) -> None:
        other = np.where(strip["labels"][:, None] == tile["labels"], NONE, score)
        for p in range(positives):
            known = strip["positives"][:, p] != NONE
            least, most = window(np.where(known, strip["positives"][:, p], 0), low, high)
            inside = (other >= np.where(known, least, 1)[:, None]) & (other <= np.where(known, most, 0)[:, None]) & (other != NONE)
            heaps.every(positives, p).offer(first, np.where(inside, other, NONE), tile["ids"])

    best = ranked(met(batches_of(asked, batches), candidates, batches, parts, lambda some: Heaps(len(some["ids"]), positives), first_positives), ["anchor", "turn"], positives)
    best = staged(best.select("anchor", "turn", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"])
    filled = F.concat(scores, F.array_repeat(F.lit(NONE), positives - F.size(scores)))
    with_scores = asked.join(best.groupBy(F.col("anchor").alias("vec_id"), "turn").agg(filled.alias("positives")), ["vec_id", "turn"])
    found = met(batches_of(with_scores, batches), candidates, batches, parts, lambda some: Heaps(len(some["ids"]) * positives, negatives), in_windows)
    negative = ranked(found.withColumn("place", F.col("place") + 1), ["anchor", "turn", "place"], negatives)
    return negative.join(best.withColumn("place", F.col("place").cast("long")), ["anchor", "turn", "place"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def ranked(entries: DataFrame, owner: list[str], size: int) -> DataFrame:
    """The heaps of all tasks as one for each owner, with the rank of each entry in it."""
    rank = F.row_number().over(W.partitionBy(*owner).orderBy(F.desc("score"), "id"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= size)


def shifted(vec_id: Column, label: Column) -> Column:
    """The contract's labels: those of ids divisible by 7 are moved on by one."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(vectors.withColumn("label", shifted(F.col("vec_id"), F.col("label"))))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 10
"""
