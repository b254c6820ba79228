"""Embedding near-dedup: exact cosine links by PCA-ordered comparison of tiles.

Equal vectors of a label form one class, which counts as often as it occurs.
The classes of a label are dealt into tiles of bounded size and each pair of
tiles is one group. In a group, unit vectors are projected on the leading
principal axes, which are those of a bounded sample; products grow by some of these dimensions at a
time, and a pair is given up once its product so far plus the product of the two
remaining norms (Cauchy-Schwarz) cannot reach the threshold; this holds for any axes, so the sample
decides on speed alone. Pairs that remain are
computed again on the vectors as given, in double precision.

A group returns how many links each of its classes has there and a spanning forest of the links
it found, never the links themselves, so a dense cluster does not
emit the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components

TILE_ROWS, STEP, STRIP = 2_048, 16, 64
#: Vectors of one length that the axes are computed from, axes that are used, and the fewest classes of a length that get axes of their own.
SAMPLE_ROWS, LEADING, FEWEST = 1_024, 128, 1_000


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles, each brought by a power of two to a largest component between a half and 1, so that no square overflows or vanishes; cosines stay as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), dims)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def leading_axes(x: np.ndarray) -> np.ndarray:
    """Up to LEADING orthonormal columns, along which the unit vectors of x are longest, the longest first."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.svd(x, full_matrices=False)[2].T
    return np.linalg.qr(axes[:, :LEADING])[0]


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors with FEWEST classes or more, its leading axes, from about SAMPLE_ROWS vectors whose hashes choose them."""
    many = classes.groupBy("dims").agg(F.count("*").alias("n")).where(F.col("n") >= FEWEST)
    chosen = classes.join(many, "dims").where(F.pmod(F.xxhash64("vector", F.lit(3)), F.ceil(F.col("n") / SAMPLE_ROWS)) == 0).select("dims", "vector")

    def axes(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        return pa.table({"dims": table["dims"][:1], "axes": pa.array([leading_axes(vectors(table["vector"], dims)).tobytes()], pa.binary())})

    rows = chosen.groupBy("dims").applyInArrow(axes, "dims int, axes binary").toLocalIterator()  # a matrix for each length that is common
    return {r["dims"]: np.frombuffer(r["axes"]).reshape(r["dims"], -1) for r in rows}


def linked(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs with a cosine of at least `least`; turned are the unit vectors' leading components, or some of them."""
    dims = turned_a.shape[1]
    steps = [*range(STEP, dims, STEP), dims]
    # what is left of a unit vector's length behind each step, with a margin for rounding
    rest_a, rest_b = ([np.sqrt(np.maximum(0, 1 + 1e-12 - (t[:, :s] ** 2).sum(axis=1))) for s in steps] for t in (turned_a, turned_b))
    length_a, length_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    reach = least - 1e-9
    for start in range(0, len(a), STRIP):
        rows = slice(start, start + STRIP)
        product = turned_a[rows, : steps[0]] @ turned_b[:, : steps[0]].T
        i, j = np.nonzero(product + np.outer(rest_a[0][rows], rest_b[0]) >= reach)
        product = product[i, j]
        i = i + start
        for s, (begin, end) in enumerate(zip(steps, steps[1:]), 1):
            product += np.einsum("ij,ij->i", turned_a[i, begin:end], turned_b[j, begin:end])
            live = product + rest_a[s][i] * rest_b[s][j] >= reach
            i, j, product = i[live], j[live], product[live]
        for k in range(0, len(i), 8_192):
            x, y = i[k : k + 8_192], j[k : k + 8_192]
            yes = (a[x] * b[y]).sum(axis=1) / (length_a[x] * length_b[y]) >= least
            found.append((x[yes], y[yes]))
    return tuple(np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in (0, 1))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number that each of n rows reaches by the links a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        root = root[root]
        if (root == before).all():
            return root


def near_duplicates(rows: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id, embedding, label).

    Vectors are linked when their labels are equal and not null, their lengths
    agree and their cosine is `least` or more. Vectors that are null, empty, zero
    or hold null or non-finite components, and rows with a null id, link with nothing: n_links 0, component_id
    their own id, kept (a null id has a null component and is kept). Equal vectors of a label are
    linked, repeated rows too, each row counting as one vector; rows that share an id are one
    component. An empty table gives an empty result; other columns are ignored."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    usable = finite & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    taken = rows.select("vec_id", "label", F.when(usable, F.col("embedding")).alias("vector"))
    classes = staged(
        taken.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies")).withColumn("dims", F.size("vector"))
    )
    axes = principal_axes(classes)
    tiles = classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("vector"), F.col("tiles")).cast("int")
    dealt = (
        classes.join(tiles, ["label", "dims"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("label", "dims", "rep", "copies", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def compare(table: pa.Table) -> pa.Table:
        dims = table["dims"][0].as_py()
        x, rep, copies = vectors(table["vector"], dims), table["rep"].to_numpy(), table["copies"].to_numpy()
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        turned = unit @ axes[dims] if dims in axes else unit[:, :LEADING]
        first = table["own"].to_numpy() == table["i"][0].as_py()
        same = table["i"][0].as_py() == table["j"][0].as_py()
        ia = np.flatnonzero(first)
        ib = ia if same else np.flatnonzero(~first)
        a, b = linked(x[ia], x[ib], turned[ia], turned[ib], least)
        a, b = ia[a], ib[b]
        if same:
            a, b = a[a < b], b[a < b]
        n = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        root = forest(len(x), a, b)
        some, hung = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(x)))
        return pa.table(
            {
                "a": np.concatenate([rep[some], rep[hung]]),
                "b": pa.array(np.concatenate([rep[some], rep[root[hung]]]), mask=np.arange(len(some) + len(hung)) < len(some)),
                "links": np.concatenate([n[some], 0 * hung]).astype(np.int64),
            }
        )

    found = staged(dealt.groupBy("label", "dims", "i", "j").applyInArrow(compare, "a long, b long, links long"))
    degrees = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL")).withColumnRenamed("node", "rep")
    known = classes.join(degrees, "rep", "left").join(roots, "rep", "left").select("label", "vector", "copies", "links", F.coalesce("component", "rep").alias("component"))
    joined = taken.join(known, ["label", "vector"], "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return joined.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT reach.n, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT v.vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) d ON d.a = v.vec_id
JOIN (SELECT n, min(r) AS component_id FROM reach GROUP BY n) c ON c.n = v.vec_id
"""
