"""Centroid clustering by bisector tournaments on whole numbers.

For every pair of centroids the bisector is computed ahead: an integer normal and a threshold, so that the sign of one
linear form tells which of the two is nearer. A vector's nearest of k centroids is what k - 1 such tests leave; zero
favours the smaller number. Only the winner's distance is ever computed. Each round reads the staged vectors once; a task
gives the sums of its clusters, and what comes to the driver is a row for each cluster and component."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import MOST_SCORE, quantised
from .common import small_batches, staged

#: Vectors that one matrix of tests takes at once, and bits of the lower part in which components are added up.
ROWS, LOW_BITS = 4_096, 31
#: Linear forms below this are exact in 64 bits.
SAFE = 2.0**62


class Tournament:
    """The bisectors of some centroids, vectors of whole numbers of any size."""

    def __init__(self, centroids: list[list[int]]) -> None:
        c = np.array(centroids, object).reshape(len(centroids), -1)
        normal, square = 2 * (c[None, :, :] - c[:, None, :]), (c * c).sum(axis=1)
        threshold = square[None, :] - square[:, None]
        self.exact = (c, normal, threshold)
        self.length = float(np.sqrt((normal.astype(float) ** 2).sum(axis=2).max(initial=0)))
        self.reach = float(np.sqrt((c.astype(float) ** 2).sum(axis=1).max(initial=0)))
        self.most = float(np.abs(threshold.astype(float)).max(initial=0))
        self.fits = max(self.length, self.most) < SAFE
        self.whole = tuple(x.astype(np.int64) for x in self.exact) if self.fits else self.exact

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row of x, and the squared distance to it, within 64 bits."""
        number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        # all forms, thresholds and squared distances stay in 64 bits
        small = self.fits & (length * self.length + self.most < SAFE) & ((length + self.reach) ** 2 < SAFE)
        for rows, (centroids, normal, threshold), kind in ((np.flatnonzero(small), self.whole, np.int64), (np.flatnonzero(~small), self.exact, object)):
            if not len(rows):
                continue
            some, left = x[rows].astype(kind), np.zeros(len(rows), np.int64)
            for rival in range(1, len(centroids)):
                side = (some * normal[left, rival]).sum(axis=1) - threshold[left, rival]
                left[side > 0] = rival  # nearer to the rival; zero keeps the smaller number
            apart = some - centroids[left]
            number[rows], distance[rows] = left, np.minimum((apart * apart).sum(axis=1), MOST_SCORE).astype(np.int64)
        return number, distance


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dims)


def _sums(vectors: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """cluster, d, n, high, low: what the vectors of each cluster add up to in a task, components in two parts that can't overflow."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament, k = Tournament(centroids), len(centroids)
        n, high, low = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                x = _matrix(part.column("value").slice(at, ROWS), dims)
                number, _ = tournament.assigned(x)
                for c in np.unique(number):
                    own = x[number == c]
                    n[c] += len(own)
                    high[c] += (own >> LOW_BITS).sum(axis=0)
                    low[c] += (own & (2**LOW_BITS - 1)).sum(axis=0)
        c, d = (g.ravel() for g in np.meshgrid(np.flatnonzero(n), np.arange(dims), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (c, d, n[c], high[c, d], low[c, d])], names=["cluster", "d", "n", "high", "low"])

    made = vectors.select("value").mapInArrow(run, "cluster long, d long, n long, high long, low long")
    return made.groupBy("cluster", "d").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors (vec_id, embedding) that have `dims` finite components.

    Components count as floor(256 x). The first centroids are the k vectors whose ids after `seed` have the smallest sha256, repeated ids in the order of
    their components; with fewer vectors there are as many centroids. Each round assigns every vector to the nearest one, ties to the smaller number,
    and moves centroids that have vectors to the floor of their mean; then vectors are assigned once more. Vectors that are null, of another
    length, or hold null or non-finite components are left out. Vectors without an id are clustered, but are no first centroids. Equal rows count as often as they occur; an empty
    table gives an empty result; other columns are ignored. Components of 2**54 and more count as that, and distances and inertias beyond 64 bits as the largest of these."""
    value = quantised(F.col("embedding"))
    kept = staged(vectors.where(F.size("embedding") == dims).select("vec_id", value.alias("value")).where("value IS NOT NULL"))
    hashed = kept.where("vec_id IS NOT NULL").withColumn("sha", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256))
    centroids = [list(r["value"]) for r in hashed.orderBy("sha", "value").select("value").limit(k).collect()]  # k rows
    if not centroids:
        return kept.where("false").select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    small_batches(kept)
    for _ in range(rounds):
        for r in _sums(kept, centroids, dims).collect():  # k times dims rows
            centroids[r["cluster"]][r["d"]] = ((r["high"] << LOW_BITS) + r["low"]) // r["n"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                number, distance = tournament.assigned(_matrix(some.column("value"), dims))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    own = staged(kept.mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"))
    by_cluster = {r["cluster"]: int(r["inertia"]) for r in own.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows
    total = min(sum(by_cluster.values()), MOST_SCORE)
    said = [(c, min(n, MOST_SCORE), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in sorted(by_cluster.items())]
    table = kept.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return own.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    near = """a{1} AS MATERIALIZED (
  SELECT vec_id, any_value(q) AS q, CAST(min_by(c, (d, c)) AS INT) AS c, min(d) AS d FROM (
    SELECT v.vec_id, v.q, c{0}.c, CAST(list_sum(list_transform(list_zip(v.q, c{0}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{0}) GROUP BY vec_id)"""
    move = """c{1} AS MATERIALIZED (
  SELECT c{0}.c, coalesce(m.q, c{0}.q) AS q FROM c{0} LEFT JOIN (
    SELECT c, list(m ORDER BY i) AS q FROM (
      SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
        SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM a{1}) GROUP BY c, i)) GROUP BY c) m ON m.c = c{0}.c)"""
    steps = [s.format(n, n + 1) for n in range(5) for s in (near, move)] + [near.format(5, 6)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS c, q FROM (SELECT q, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40)),
{", ".join(steps)}
SELECT vec_id, a6.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a6.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c5.q, ',')) AS centroid_sha256
FROM a6 JOIN c5 ON c5.c = a6.c
"""


OP13_SQL = _oracle()
