"""Mixing sources to target weights by Efraimidis-Spirakis keys, on DataFrame operations only.

Each document draws an exponential key with rate equal to its quality, from a
hash of its id. Within a source, documents in key order are a sample without
replacement weighted by quality; running sums of their sizes fill the source's
token budget. A budget above the source's size takes whole epochs first, and
only the rest is chosen by key.

What is taken is, in each source, the documents up to one place in key order, and that
place is all that has to be found. The keys of a source are cut into ranges of about
equal numbers of documents, by the distribution that its qualities give them; sums over ranges show in which
one the place lies, and only the documents of that one are put in order. Every document is then held
against its source's place, so a source may hold any share of the rows, no step gathers it in
one task, and texts never enter a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, staged

#: Documents of one source that a range of keys is meant to hold, and the bins in which its qualities are counted.
RANGE_ROWS, QUALITY_BINS = 2_000, 64


def text_quality(text: Column) -> Column:
    """Share of letters among the characters, at least 0.05; the sampling rate of a document."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters.cast("double"), F.length(text)), F.lit(0.05)))


def exponential_key(doc_id: Column, text: Column, quality: Column) -> Column:
    """-ln(u) / quality, with u in (0, 1) from 52 bits of the md5 of the id as text, or of the text where there is no id."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / quality


def numbered(sources: DataFrame) -> DataFrame:
    """sources (no_source, name, ...) with `turn`, from 0 in that order: ranges are counted, so no task sees all of them."""
    dealt = staged(sources.repartitionByRange("no_source", "name").withColumn("slice", F.spark_partition_id()))
    before = dealt.groupBy("slice").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("slice")) - F.col("n"))  # a row a partition
    within = F.row_number().over(W.partitionBy("slice").orderBy("no_source", "name")) - 1
    return dealt.join(before.select("slice", "before"), "slice").withColumn("turn", F.col("before") + within).drop("slice", "before")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (no_source, name, source_size), one row each.

    Sources in the order of their code points, the null source last, weigh
    `weights` in turn and share `share` times all sizes. A target stops at
    `most` times its source's size and the excess is shared again by weight
    among the rest: the level, target by weight, rises as sources become full, until
    none does any more. Each round is one sum over all sources."""
    by_turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    named = staged(numbered(sizes).select("no_source", "name", "source_size", by_turn.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    level, before = 0.0, None
    while before is None or level > before:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        sums = named.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")
        ).first()
        before = level
        if sums["open"]:
            level = max(level, ((sums["all"] or 0) * share - sums["full"]) / sums["open"])
    return named.select("no_source", "name", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def sized(docs: DataFrame, quality: Column) -> list[Column]:
    """The columns that a document is mixed by."""
    return [
        docs["source"].isNull().alias("no_source"),
        F.coalesce(docs["source"], F.lit("")).alias("name"),
        docs["doc_id"].alias("id"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        quality.alias("quality"),
        exponential_key(docs["doc_id"], docs["text"], quality).alias("key"),
    ]


SOURCE = ["no_source", "name"]


def ranged(rows: DataFrame) -> DataFrame:
    """rows with `part`, the range of their source's keys: the share of the source that is to be expected below a key, times the number of ranges.

    Of documents of rate q, the share 1 - exp(-q key) has a smaller key. Each source's qualities are counted in bins;
    the sum over these grows with the key, so ranges are in the order of keys."""
    counted = rows.groupBy(*SOURCE, F.floor(F.col("quality") * QUALITY_BINS).alias("bin")).agg(F.count("*").alias("n"), F.avg("quality").alias("q"))
    bins = F.sort_array(F.collect_list(F.struct("bin", "q", F.col("n").cast("double").alias("n"))))  # QUALITY_BINS + 1 at most
    by_source = staged(counted.groupBy(*SOURCE).agg(bins.alias("bins"), F.sum("n").alias("rows")))  # a table of known size: Spark broadcasts it if it is small
    below = F.aggregate("bins", F.lit(0.0), lambda sum_, b: sum_ + b["n"] * (1 - F.exp(-F.col("key") * b["q"])))
    ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    part = F.least(ranges - 1, F.floor(below / F.col("rows") * ranges)).cast("long")
    return rows.join(by_source, SOURCE).withColumn("part", part).drop("bins", "rows")


def places(rows: DataFrame, **options: object) -> DataFrame:
    """For each source of rows: source_size, target, epochs, and the place up to which documents are taken once more.

    The place is the key of the last range that is taken whole (low_key, if there is one), and in the range after it a key, id and size
    (at_key, at_id, at_size, if anything of that range is taken), with the number of rows like these (alike) and how many of them are taken (of_alike)."""
    parts = staged(rows.groupBy(*SOURCE, "part").agg(F.sum("size").alias("part_size"), F.max("key").alias("last_key")))
    targets = source_targets(parts.groupBy(*SOURCE).agg(F.sum("part_size").alias("source_size")), **options)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    targets = staged(targets.withColumn("epochs", epochs.cast("long")).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")))
    earlier = W.partitionBy(*SOURCE).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    summed = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0))).withColumn("low_key", F.max("last_key").over(earlier))
    here = staged(summed.join(targets, SOURCE).where("offset <= left AND left < offset + part_size").select(*SOURCE, "part", "offset", "left", "low_key"))
    same = rows.where("size > 0").join(here, [*SOURCE, "part"]).groupBy(*SOURCE, "part", "offset", "left", "key", "id", "size").agg(F.count("*").alias("alike"))
    before = W.partitionBy(*SOURCE).orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    upto = F.col("offset") + F.coalesce(F.sum(F.col("alike") * F.col("size")).over(before), F.lit(0))
    fitting = F.floor((F.col("left") - upto) / F.col("size") + 0.5)  # those whose middle word still lies within what is left
    taken = same.withColumn("of_alike", F.least(F.col("alike"), fitting)).where("of_alike > 0")
    last = taken.groupBy(*SOURCE).agg(F.max(F.struct(F.col("key"), F.col("id").isNotNull().alias("has"), F.col("id"), F.col("size"), F.col("alike"), F.col("of_alike"))).alias("last"))
    found = targets.join(here.select(*SOURCE, "low_key"), SOURCE, "left").join(last, SOURCE, "left")
    at = [F.col(f"last.{c}").alias(f"at_{c}") for c in ("key", "id", "size")]
    return staged(found.select(*SOURCE, "source_size", "target", "epochs", "low_key", *at, "last.alike", "last.of_alike"))


def once_more() -> tuple[Column, Column]:
    """Whether a row with words lies before its source's place, and whether it is one of those at it."""
    c = F.col
    same_id = c("id").eqNullSafe(c("at_id"))
    smaller = (c("id").isNull() & c("at_id").isNotNull()) | (c("id") < c("at_id")) | (same_id & (c("size") < c("at_size")))
    before = (c("key") <= c("low_key")) | (c("key") < c("at_key")) | ((c("key") == c("at_key")) & smaller)
    at = (c("key") == c("at_key")) & same_id & (c("size") == c("at_size"))
    return F.coalesce((c("size") > 0) & before, F.lit(False)), F.coalesce(at, F.lit(False))


def mix(docs: DataFrame, quality: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often each document enters the mix: the columns doc_id, source, size, source_size, target, copies, taken.

    docs has doc_id, text, source; any other columns are ignored, whatever
    their names. size counts the words of the text (null and empty text: 0).
    A document is taken whole: as often as there are whole epochs in its
    source's target, and once more if in key order the middle of its words
    lies within what is left of the target, which rounds to the nearest whole
    document. Equal keys are ordered by doc_id, then size. Rows without an id draw by
    their text; rows that repeat are taken row by row. A source without words has target 0
    and nothing is taken from it; an empty table gives an empty result. The
    draw depends on ids (or texts) only, so reruns agree."""
    quality = text_quality(docs["text"]) if quality is None else quality
    rows = staged(docs.select(*sized(docs, quality)))
    placed = rows.join(places(ranged(rows), weights=weights, share=share, most=most), SOURCE)
    before, at = once_more()
    rest = placed.where(~at).withColumn("more", before.cast("long"))
    # rows at the place are all alike: so many of them once more, the others not
    alike = placed.where(at).groupBy(*SOURCE).agg(*[F.first(c).alias(c) for c in placed.columns if c not in SOURCE])
    dealt = alike.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("alike") / 1_000) - 1)).alias("thousand"))
    dealt = dealt.select("*", F.explode(F.sequence(F.col("thousand") * 1_000 + 1, F.least(F.col("alike"), (F.col("thousand") + 1) * 1_000))).alias("one"))
    both = rest.unionByName(dealt.withColumn("more", (F.col("one") <= F.col("of_alike")).cast("long")).select(*rest.columns))
    copies = F.least(F.lit(int(most)), F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(0)) + F.col("more"))
    return both.withColumn("copies", copies.cast("long")).select(
        F.col("id").alias("doc_id"),
        F.when(~F.col("no_source"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, quality: Column | None = None, most: float = 2.0, **options: object) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with the columns of docs.

    Every row is held against its source's place where it lies, and texts aren't shuffled, but for rows at a place that are alike in source, id, key
    and size, and of which only some are taken once more: these are numbered, within the slices that tasks read."""
    quality = text_quality(docs["text"]) if quality is None else quality
    own = sized(docs, quality)
    at = places(ranged(staged(docs.select(*own))), most=most, **options)
    names = [f"d{n}" for n in range(len(docs.columns))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], *own).drop("quality")
    before, at_place = once_more()
    placed = rows.join(at, SOURCE)
    more = F.when(before | (at_place & (F.col("of_alike") == F.col("alike"))), 1).otherwise(0)
    copies = F.least(F.lit(int(most)), F.when(F.col("size") > 0, F.col("epochs")).otherwise(F.lit(0)) + more)
    many = placed.withColumn("copies", copies.cast("int")).where("copies > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)
    some = at.where("of_alike < alike")
    if not some.isEmpty():  # only where rows repeat
        alike = staged(rows.join(some, SOURCE).where(at_place).select(*SOURCE, "of_alike", *names, F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("line")))
        counts = alike.groupBy(*SOURCE, "slice").agg(F.count("*").alias("n"))  # a row a partition
        earlier = counts.withColumn("earlier", F.sum("n").over(W.partitionBy(*SOURCE).orderBy("slice")) - F.col("n")).drop("n")
        number = F.row_number().over(W.partitionBy(*SOURCE, "slice").orderBy("line")) + F.col("earlier")
        many = many.unionByName(alike.join(earlier, [*SOURCE, "slice"]).withColumn("number", number).where("number <= of_alike").select(*names))
    return many.toDF(*docs.columns)


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


#: The same draw in DuckDB's SQL.
OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    greatest(0.05, coalesce(CAST(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS DOUBLE) / nullif(length(text), 0), 0.05)) AS quality, coalesce(CAST(doc_id AS VARCHAR), text, '') AS draw
  FROM documents),
keyed AS (
  SELECT doc_id, size, source, source IS NULL AS no_source, coalesce(source, '') AS name,
    -ln((CAST(CAST('0x' || substr(md5(draw), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / quality AS key
  FROM sized),
sources AS (SELECT no_source, name, sum(size) AS source_size FROM keyed GROUP BY ALL),
weighed AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY no_source, name) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / weight, no_source, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT no_source, name, CAST(source_size AS BIGINT) AS source_size,
    CASE WHEN cap > weight * level THEN weight * max(CASE WHEN cap > weight * level THEN level END) OVER () ELSE cap END AS target
  FROM leveled),
placed AS (
  SELECT k.*, t.source_size, t.target, sum(size) OVER (PARTITION BY k.no_source, k.name ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto,
    coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS epochs
  FROM keyed k JOIN targets t ON k.no_source = t.no_source AND k.name = t.name),
taken AS (
  SELECT *, CAST(least(2, CASE WHEN size > 0 THEN epochs ELSE 0 END + CASE WHEN size > 0 AND upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS copies
  FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken
"""
