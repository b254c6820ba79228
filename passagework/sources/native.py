"""Readers that Spark's own functions express: plain text and simple HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import LIST_LINE
from ..functions.text import strip_markdown, table_text

# The named entities that are decoded, ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def text_blocks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, ord, kind, text, level of each paragraph between blank lines of a plain text.

    A paragraph is a heading if it is one short line that starts like one, ends
    without punctuation, and is not the last; level 1 in capitals, else 2.
    Lines of a list stay lines, other lines are joined."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "^﻿", "")
    trimmed = F.transform(F.split(clean, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    parts = docs.select(F.col(key), F.filter(trimmed, lambda p: p != "").alias("parts"))
    each = parts.select(key, F.size("parts").alias("n"), F.posexplode("parts").alias("ord", "p"))
    p = F.col("p")
    heading = (
        ~p.contains("\n") & (F.length(p) <= 80) & (F.col("ord") < F.col("n") - 1) & ~p.rlike("[.!?,;:]$") & p.rlike(r"^[\p{Lu}0-9]") & (F.size(F.split(p, r"\s+")) <= 10)
    )
    lines = F.transform(F.split(p, "\n"), lambda x: F.trim(x))
    is_list = (F.size(lines) > 1) & F.forall(lines, lambda x: x.rlike(LIST_LINE))
    return each.select(
        key,
        "ord",
        F.when(heading, "heading").otherwise("paragraph").alias("kind"),
        F.when(heading, p).when(is_list, F.array_join(lines, "\n")).otherwise(F.array_join(lines, " ")).alias("text"),
        F.when(heading, F.when(p == F.upper(p), 1).otherwise(2)).alias("level"),
    )


def html_text(fragment: Column) -> Column:
    """Text of an HTML fragment: br is a space, tags go, named entities are decoded, white space is single."""
    text = F.regexp_replace(F.regexp_replace(fragment, "(?i)<br[^>]*>", " "), "<[^>]+>", "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_elements(pages: DataFrame, key: str, html: Column, tag: str) -> DataFrame:
    """key, ord, text of the non-empty elements of one tag in order; list items begin with a dash."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    each = pages.select(F.col(key), F.posexplode(found).alias("ord", "inner")).withColumn("text", html_text(F.col("inner"))).where("text <> ''")
    return each.select(key, "ord", F.concat(F.lit("- " if tag == "li" else ""), F.col("text")).alias("text"))


# Lines of Markdown.
FENCE, ATX, UNDERLINE = r"^\s*```", r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", r"^\s*(=+|-{3,})\s*$"
TABLE_ROW, RULE_ROW, ITEM = r"^\s*\|.*\|\s*$", r"^\s*\|?\s*:?-{2,}", r"^\s*([-*+]|\d{1,3}[.)])\s+"


def markdown_lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, n, line, what, after of the lines of Markdown texts that say something: n numbers all lines, after is the next one.

    what is fenced, atx, setext (the line above an underline), table, item, blank or plain. Fences change places by running parity. A line
    is setext if an underline follows and no paragraph is open: then the line before is none of a paragraph, or is an underline that
    belongs to the line before it. That goes back from heading to heading by two lines, and the first of them decides. An underline is never itself a heading's text."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "^\ufeff", "")
    lines = docs.select(F.col(key).alias("__key"), F.posexplode(F.split(clean, "\n")).alias("n", "line"))
    own = W.partitionBy("__key").orderBy("n")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    line = F.col("line")
    marked = lines.withColumn("fence", line.rlike(FENCE)).withColumn("after", F.lead("line").over(own)).withColumn("fenced", F.count_if("fence").over(upto) % 2 == 1)
    what = F.when(F.col("fenced"), "fenced").when(line.rlike(ATX), "atx").when(line.rlike(TABLE_ROW), "table").when(F.trim(line) == "", "blank").when(line.rlike(ITEM), "item").otherwise("plain")
    said = marked.where("NOT fence").withColumn("what", what).withColumn("turn", F.row_number().over(own)).withColumn("underline", (F.col("what") == "plain") & line.rlike(UNDERLINE))
    said = said.withColumn("open", F.col("what").isin("plain", "fenced"))
    may = ~F.col("what").isin("fenced", "atx", "blank") & ~F.col("underline") & F.coalesce(F.col("after").rlike(UNDERLINE), F.lit(False))
    said = said.withColumn("may", may)
    back = lambda c, by: F.lag(c, by).over(own)
    linked = F.col("may") & F.coalesce(back("underline", 1) & back("may", 2) & (back("n", 1) == back("n", 2) + 1), F.lit(False))
    first = F.col("may") & ~F.coalesce(back("open", 1), F.lit(False))
    decided = said.withColumn("linked", linked).withColumn("first", first)
    apart = W.partitionBy("__key", F.col("turn") % 2).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    setext = F.when(F.col("linked"), F.last(F.when(~F.col("linked"), F.col("first")), ignorenulls=True).over(apart)).otherwise(F.col("first"))
    told = decided.withColumn("setext", setext)
    spent = F.col("underline") & F.coalesce(F.lag("setext").over(own) & (F.lag("n").over(own) == F.col("n") - 1), F.lit(False))
    return told.withColumn("spent", spent).where("NOT spent").select(F.col("__key").alias(key), "n", "line", F.when(F.col("setext"), "setext").otherwise(F.col("what")).alias("what"), "after")


def markdown_blocks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, ord, kind, text, level of the blocks of Markdown texts: headings of both styles, pipe tables, an item a paragraph, other paragraphs up to what ends them.

    A paragraph or table is a session of lines between those that end it. Where fenced lines follow a table, both are open, and the line
    that ends both gives the table first, but for a heading and the end, which give the paragraph first. Marks go, their contents stay."""
    lines = markdown_lines(docs, key, text).withColumnRenamed(key, "__key")
    own = W.partitionBy("__key").orderBy("n")
    upto, onward = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(1, W.unboundedFollowing)
    what = F.col("what")
    ends_text, ends_table = what.isin("atx", "setext", "table", "blank", "item"), what.isin("atx", "setext", "blank", "item", "plain")
    head = what.isin("atx", "setext")
    seen = lines.withColumns({"texts": F.count_if(ends_text).over(upto), "tables": F.count_if(ends_table).over(upto)})
    # the line that ends what a line belongs to: its number, and whether it is a heading
    end = lambda ends: F.first(F.when(ends, F.struct("n", head.alias("head"))), ignorenulls=True).over(onward)
    seen = seen.withColumns({"text_end": end(ends_text), "table_end": end(ends_table)})
    last = F.struct(F.lit(2**31 - 1).alias("n"), F.lit(True).alias("head"))
    place = lambda c, first, then: F.struct(F.coalesce(c, last)["n"].alias("n"), F.when(F.coalesce(c, last)["head"], first).otherwise(then).alias("sub"))
    alone = F.struct(F.col("n"), F.lit(2).alias("sub"))
    in_order = lambda field: F.transform(F.array_sort(F.collect_list(F.struct("n", field))), lambda s: s[field])
    one_line = lambda t: F.trim(F.regexp_replace(strip_markdown(t), r"\s*\n\s*", " "))
    raw = F.when(what == "atx", F.regexp_extract("line", ATX, 2)).otherwise(F.col("line"))
    level = F.when(what == "atx", F.length(F.regexp_extract("line", ATX, 1))).otherwise(F.when(F.trim("after").startswith("="), 1).otherwise(2))
    headings = seen.where(head).select("__key", alone.alias("place"), F.lit("heading").alias("kind"), F.trim(strip_markdown(raw)).alias("text"), level.alias("level"))
    items = seen.where(what == "item").select("__key", alone.alias("place"), F.lit("paragraph").alias("kind"), one_line(F.col("line")).alias("text"), F.lit(None).cast("int").alias("level"))
    held = seen.where(what.isin("plain", "fenced")).groupBy("__key", "texts").agg(F.max("text_end").alias("end"), F.array_join(in_order("line"), "\n").alias("raw"))  # one paragraph's lines
    paragraphs = held.select("__key", place(F.col("end"), 0, 1).alias("place"), F.lit("paragraph").alias("kind"), one_line(F.col("raw")).alias("text"), F.lit(None).cast("int").alias("level"))
    bare = F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", "")
    cells = F.transform(F.split(bare, r"\|"), lambda c: F.trim(strip_markdown(c)))
    rows = seen.where((what == "table") & ~F.col("line").rlike(RULE_ROW)).withColumn("cells", cells)
    tabled = rows.groupBy("__key", "tables").agg(F.max("table_end").alias("end"), in_order("cells").alias("cells"))  # one table's rows
    tables = tabled.select("__key", place(F.col("end"), 1, 0).alias("place"), F.lit("table").alias("kind"), F.array_join(table_text(F.col("cells")), "\n").alias("text"), F.lit(None).cast("int").alias("level"))
    blocks = headings.unionByName(items).unionByName(paragraphs).unionByName(tables).where("text <> ''")
    return blocks.select(F.col("__key").alias(key), (F.row_number().over(W.partitionBy("__key").orderBy("place")) - 1).cast("int").alias("ord"), "kind", "text", "level")


def with_titles(blocks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The titles (key, title) and the other blocks: the first block is the title if it is the only heading of level 1 and more follows."""
    own = W.partitionBy(key)
    top = (F.col("kind") == "heading") & (F.col("level") == 1)
    titled = (F.col("ord") == 0) & top & (F.count_if(top).over(own) == 1) & (F.count("*").over(own) > 1)
    marked = blocks.withColumn("titled", titled)
    return marked.where("titled").select(key, F.col("text").alias("title")), marked.where("NOT titled").drop("titled")
