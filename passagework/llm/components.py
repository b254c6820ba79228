"""Connected components of a graph too large for one machine: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest id reachable, for every node of edges (a, b).

    Loops, repeated and reversed edges are allowed, edges with a null end are
    ignored, and no edges give no rows. A large-star step links the larger
    neighbours of each node to the smallest one, a small-star step the smaller
    ones; they alternate until every node hangs on the smallest of its component,
    which one grouping tells, so that edges that are stars already take no step. Each step is grouping (combined before the
    shuffle) and an equi-join that AQE can split, so no node's neighbours, a
    hub's neither, must fit into one task."""
    up = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    pairs = staged(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*up).distinct())
    while not stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # a pair may be there several times, never more often than there are pairs before the step; the end of the round drops that
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = staged(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
    hung = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def stars(pairs: DataFrame) -> bool:
    """Whether every u of the pairs (u, v), u > v, has one v only, which is no u itself."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    per_node = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return per_node.where("below > 1 OR below = 1 AND above = 1").isEmpty()
