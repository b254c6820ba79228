"""Relational reads of the workflow: lists, joins, dedup, statistics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def review_status(quality: Column, toxic: Column) -> Column:
    """REJECTED, APPROVED or DRAFT of a label; PENDING without one."""
    return F.when(toxic == 1, "REJECTED").when(quality == 1, "APPROVED").when(toxic.isNotNull() | quality.isNotNull(), "DRAFT").otherwise("PENDING")


def stats(rows: DataFrame, status: Column) -> DataFrame:
    """One row: total, pending, drafted, approved, rejected."""
    of = lambda s: F.count_if(status == s)
    return rows.agg(F.count("*").alias("total"), of("PENDING").alias("pending"), of("DRAFT").alias("drafted"), of("APPROVED").alias("approved"), of("REJECTED").alias("rejected"))


def with_child_count(parents: DataFrame, key: str, children: DataFrame, child_key: str, name: str = "children") -> DataFrame:
    """parents with the number of their children, 0 without any; children are counted before they are shuffled."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def without(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    return rows.join(others.select(F.col(other_key).alias(key)), key, "left_anti")


def exact_duplicates(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """sha256, copies and the smallest key of every distinct text; combined before the shuffle."""
    return docs.select(F.col(key), F.sha2(text.cast("binary"), 256).alias("sha256")).groupBy("sha256").agg(F.count("*").alias("copies"), F.min(key).alias("first_id"))


def neighbours(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """rows with the text before and after within a group."""
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumn("before", F.lag(text).over(w)).withColumn("after", F.lead(text).over(w))


def escaped_cell(cell: Column, delimiter: str = ",", protect: bool = True) -> Column:
    """A CSV cell: formulas get an apostrophe, quotes are doubled, cells that need it are quoted; null is empty."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    if protect:
        text = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    needs = text.contains('"') | text.contains(delimiter) | text.rlike(r"[\r\n]")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*cells: Column, delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[escaped_cell(c, delimiter) for c in cells])


def labelled_row(header: list[str], cells: list[Column]) -> Column:
    """"Header: value; …" without empty values."""
    parts = [F.when(F.length(c.cast("string")) > 0, F.concat(F.lit(f"{h}: "), c.cast("string"))) for h, c in zip(header, cells)]
    return F.concat_ws("; ", *parts)


def safe_filename(name: Column) -> Column:
    clean = F.substring(F.regexp_replace(name, r"[^\w.-]+", "_"), 1, 60)
    return F.when(F.length(clean) > 0, clean).otherwise("answers")
