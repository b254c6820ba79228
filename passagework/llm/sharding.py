"""Sharding by longest-processing-time scheduling: groups of equal texts, the largest first, go to the least-loaded shard.

What the heap schedules is of bounded number whatever the input. A group of at least 1/PARTS of all bytes is scheduled for
itself, and there are PARTS of these at most. Smaller groups are bundled by their digests, and a bundle stays together as
a group does: half of the groups go into BUNDLES bundles, a quarter into as many, and so on over LEVELS, so that the last
bundles are tiny and even out what the large ones leave. Rows learn their shard by a lookup and never move for it, so a text that a
third of all rows share is no task of its own."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Groups that are scheduled for themselves, bundles of a level, and levels (as many as the bits of three hexadecimal digits).
PARTS, BUNDLES, LEVELS = 20_000, 2_048, 12


def scheduled(items: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """The shard of each (item, load): the largest first, ties by name, each to the shard with the least load, then the smallest number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, load in sorted(items, key=lambda x: (-x[1], x[0])):
        least, shard = heap[0]
        out[item] = shard
        heapq.heapreplace(heap, (least + load, shard))
    return out


def bundle(digest: Column) -> Column:
    """The bundle of a small group, from the sha256 of its text in hexadecimal digits: its level by leading zeros of the first 12 bits, its number by the next 12."""
    number = lambda at: F.conv(F.substring(digest, at, 3), 16, 10).cast("int")
    level = LEVELS - F.length(F.bin(number(1)))
    return F.concat_ws("-", level.cast("string"), F.pmod(number(4), F.lit(BUNDLES)).cast("string"))


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with `slot`, gapless from 0 within each value of the int column `by`, in the order of the other columns.

    Rows are dealt by ranges of that order; a task numbers those that it reads, and earlier tasks' counts are added. A row that repeats is told apart
    by where it lies, so one that holds a third of the table is dealt like others. `by` has few values."""
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_003))
    sorted_ = rows.withColumn("spread", spread).repartitionByRange(*order, "spread").sortWithinPartitions(*order, "spread").drop("spread")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for part in parts:
            places = []
            for value in part.column(by).to_pylist():
                places.append(seen.setdefault(value, 0))
                seen[value] += 1
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([task] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*part.schema.names, "task", "place"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = staged(sorted_.mapInArrow(run, f"{types}, task int, place long"))
    counts = dealt.groupBy(by, "task").agg(F.count("*").alias("n"))  # a row for each value in each task
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy(by).orderBy("task")) - F.col("n")).drop("n")
    return dealt.join(before, [by, "task"]).select(*rows.columns, (F.col("before") + F.col("place")).alias("slot"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs (doc_id, text).

    size is the UTF-8 bytes of the text plus 1; a null text counts as an empty one. Rows of equal texts are in one
    shard; the shards' sums of sizes are as near to equal as the groups allow. slot counts a shard's rows from 0 in the order of doc_id (null first), crc and size. Rows
    that repeat are rows each. An empty table gives an empty result; other columns are ignored."""
    text = F.coalesce(docs["text"].cast("binary"), F.lit("").cast("binary"))
    rows = staged(docs.select(docs["doc_id"].alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.sha2(text, 256).alias("digest")))
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("load")))
    total = groups.agg(F.sum("load")).first()[0] or 0
    large = F.col("load") * PARTS >= total
    items = groups.groupBy(F.when(large, F.col("digest")).otherwise(bundle(F.col("digest"))).alias("item")).agg(F.sum("load").alias("load"))
    shard = scheduled(((r["item"], r["load"]) for r in items.toLocalIterator()), shards)  # PARTS + LEVELS * BUNDLES at most
    table = docs.sparkSession.createDataFrame(list(shard.items()), "item string, of int")
    alone, bundles = (F.broadcast(some) for some in (table.where("length(item) = 64").toDF("digest", "own"), table.where("length(item) < 64").toDF("bundle", "shared")))  # as many as items
    placed = rows.withColumn("bundle", bundle(F.col("digest"))).join(alone, "digest", "left").join(bundles, "bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"))
    return numbered(small_batches(placed), "shard", "doc_id", "text_crc32", "size")


def op12_shards(spark, sf_dir: str) -> DataFrame:
    made = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _half(n: int) -> int:
    """crc32's table for four bits, from its polynomial."""
    for _ in range(4):
        n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
    return n


#: crc32 over the halves of the bytes, the lower one first, and the same schedule as a recursion over the items.
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT DISTINCT t, hex(encode(t)) AS h FROM d),
halves AS (SELECT t, list_transform(range(1, length(h) + 1), lambda i: CAST('0x' || h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END] AS BIGINT)) AS n FROM x),
crc AS MATERIALIZED (SELECT t, xor(list_reduce(list_prepend(4294967295::BIGINT, n), lambda c, b: xor(c >> 4, {[_half(n) for n in range(16)]}[(xor(c, b) & 15) + 1])), 4294967295) AS crc FROM halves),
g AS (SELECT t, sha256(t) AS h, CAST(sum(octet_length(encode(t)) + 1) AS BIGINT) AS load FROM d GROUP BY t),
b AS (SELECT t, load, CASE WHEN load * {PARTS} >= sum(load) OVER () THEN h ELSE ({LEVELS} - length(bin(CAST('0x' || substr(h, 1, 3) AS INT)))) || '-' || CAST('0x' || substr(h, 4, 3) AS INT) % {BUNDLES} END AS item FROM g),
i AS MATERIALIZED (SELECT item, load, row_number() OVER (ORDER BY load DESC, item) AS n FROM (SELECT item, CAST(sum(load) AS BIGINT) AS load FROM b GROUP BY item)),
s AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS item, list_transform(range(8), lambda z: 0::BIGINT) AS loads, 0::INT AS shard UNION ALL
  SELECT n, item, list_transform(loads, lambda l, z: CASE WHEN z = k THEN l + load ELSE l END), CAST(k - 1 AS INT) FROM (SELECT i.n, i.item, i.load, s.loads, list_position(s.loads, list_min(s.loads)) AS k FROM s JOIN i ON i.n = s.n + 1))
SELECT doc_id, CAST(octet_length(encode(d.t)) + 1 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, octet_length(encode(d.t))) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM d JOIN crc USING (t) JOIN b USING (t) JOIN s USING (item)
"""
