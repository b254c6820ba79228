"""Blocks from positioned text, as DataFrame operations: lines, columns, reading order, paragraphs.

items: doc_id, page, seq, text, x, y, w, size, font, page_width, page_height, in points with
y upwards, as any PDF decoder gives them. Every step groups or orders within a page or a document.
Runs are put into rows by a fold over one page; elsewhere a window stands for the fold:
paragraphs are numbered by the running sum of their breaks."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import CAPTION, COMPOUND_PREFIXES, COMPOUND_SUFFIXES, LIST_MARKER, NUMBERED_HEADING, PAGE_NUMBER, SECTION_NAMES
from ..functions.text import table_text
from ..sources.tables import written

# Gaps in sizes, shares of pages and runs, accents that are drawn before their letter, ligatures, and where accents stand.
CELL_GAP, SPACE_GAP, MARGIN, REPEATED, CROSSING, SIDE, LEAST_RUNS = 1.5, 0.12, 0.08, 0.4, 0.08, 0.2, 12
ACCENTS = {"˜": "\u0303", "´": "\u0301", "¨": "\u0308", "ˆ": "\u0302", "ˇ": "\u030c", "˘": "\u0306", "˚": "\u030a"}
PAGE = ["doc_id", "page"]
LETTER = r"[^\W\d_]"
# What words over line ends are made of. A pattern that looks back meets the second half of a character beyond 16 bits first.
PART, HALF = r"[\p{L}0-9]", r"[\uDC00-\uDFFF]?"
BEGINS, SEAM = rf"(?<!{PART}{HALF})", rf"-(?<={PART}{HALF}-)\n(?={PART})"
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "­": ""}
_BEFORE, _GRAVE = re.compile(rf"([{''.join(ACCENTS)}])\s?({LETTER})"), re.compile(rf"(?<={LETTER})`([A-Za-z])")


def composed(text: str) -> str:
    """Accents with their letters, as one character where there is one."""
    text = _BEFORE.sub(lambda m: m[2].replace("ı", "i") + ACCENTS[m[1]], re.sub("ı(?=[\u0300-\u036f])", "i", text))
    return unicodedata.normalize("NFC", _GRAVE.sub("\\1\u0300", text))


def in_rows(page: pa.Table) -> pa.Table:
    """The runs of one page with `row`: from the top down, a run joins the row whose largest run has its baseline within half a size."""
    page = page.sort_by([("y", "descending"), ("x", "ascending"), ("seq", "ascending")])
    rows, row, top, large = [], 0, None, 0.0
    for y, size in zip(page["y"].to_pylist(), page["size"].to_pylist()):
        if top is None or abs(top - y) > 0.5 * max(large, size):
            row, top, large = row + 1, y, size
        elif size > large:
            top, large = y, size
        rows.append(row)
    texts = pa.array([composed(t) for t in page["text"].to_pylist()], pa.string())
    return page.set_column(page.schema.get_field_index("text"), "text", texts).append_column("row", pa.array(rows, pa.int32()))


def clean_text(text: Column) -> Column:
    """Ligatures as letters, no soft hyphens and control characters, single spaces."""
    for mark, letters in LIGATURES.items():
        text = F.replace(text, F.lit(mark), F.lit(letters))
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.trim(F.regexp_replace(text, r"[\s  -​ ]+", " "))


def dominant(items: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """The value with the most text in each group, the first seen on a tie."""
    sums = items.groupBy(*by, value.alias(name)).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "seq")).alias("first"))
    return sums.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "first"))).where("k = 1").select(*by, name)


def half(size: Column) -> Column:
    return F.round(size * 2) / 2


def gutters(items: DataFrame) -> DataFrame:
    """doc_id, page, gutter, left_edge, right_edge of the pages in two columns: where fewest runs cross, nearest to the middle."""
    words = items.where(F.length(F.trim("text")) >= 3)
    runs = words.join(dominant(words, PAGE, half(F.col("size")), "page_size"), PAGE).where("abs(size - page_size) <= 1").withColumn("end", F.col("x") + F.col("w"))
    counted = runs.withColumn("runs", F.count("*").over(W.partitionBy(*PAGE))).where(F.col("runs") >= LEAST_RUNS)
    width = F.col("page_width")
    at = counted.withColumn("g", F.explode(F.sequence(F.round(width * 0.35).cast("int"), F.floor(width * 0.65).cast("int"))))
    per = at.groupBy(*PAGE, "g").agg(F.count_if((F.col("x") < F.col("g") - 1) & (F.col("end") > F.col("g") + 1)).alias("cross"), F.count_if(F.col("end") <= F.col("g")).alias("l"), F.count_if(F.col("x") >= F.col("g")).alias("r"), F.first("runs").alias("runs"), F.first("page_width").alias("width"))
    best = per.withColumn("k", F.row_number().over(W.partitionBy(*PAGE).orderBy("cross", F.abs(F.col("g") - F.col("width") / 2), "g"))).where(
        (F.col("k") == 1) & (F.col("cross") <= F.col("runs") * CROSSING) & (F.col("l") >= F.col("runs") * SIDE) & (F.col("r") >= F.col("runs") * SIDE)
    )
    edges = runs.join(best.select(*PAGE, "g"), PAGE).groupBy(*PAGE, F.col("g").alias("gutter"))
    return edges.agg(F.percentile(F.when(F.col("end") <= F.col("g"), F.col("end")), 0.98).alias("left_edge"), F.percentile(F.when(F.col("x") >= F.col("g"), F.col("x")), 0.02).alias("right_edge"))


def lines(items: DataFrame) -> DataFrame:
    """doc_id, page, side (L, R or F), x0, x1, y, size, font, cells, distinct_font, and the page's sizes."""
    seen = items.where((F.col("size") > 0) & (F.trim("text") != ""))
    body = dominant(seen, ["doc_id"], half(F.col("size")), "body_size")
    near = seen.join(body, "doc_id").where("abs(size - body_size) <= 0.6")
    font = dominant(near, ["doc_id"], F.col("font"), "body_font")
    fields = ", ".join(f"{c} {t}" for c, t in seen.dtypes)
    rows = seen.groupBy(*PAGE).applyInArrow(in_rows, f"{fields}, row int").join(gutters(seen), PAGE, "left").withColumn("end", F.col("x") + F.col("w"))  # a page at a time
    row = W.partitionBy(*PAGE, "row")
    on_left = F.col("x") + F.col("w") / 2 < F.col("gutter")
    over = F.max((F.col("x") < F.col("gutter") - 3) & (F.col("end") > F.col("gutter") + 3)).over(row)
    left_end, right_start = F.max(F.when(on_left, F.col("end"))).over(row), F.min(F.when(~on_left, F.col("x"))).over(row)
    both = F.coalesce((left_end > F.col("left_edge") + 2) | (right_start < F.col("right_edge") - 2), F.lit(False)) & left_end.isNotNull() & right_start.isNotNull()
    sided = rows.withColumn("side", F.when(F.col("gutter").isNull() | over | both, "F").when(on_left, "L").otherwise("R"))
    along = W.partitionBy(*PAGE, "row", "side").orderBy("x", "seq")
    gap = F.col("x") - F.lag("end").over(along)
    joint = F.when(gap.isNull(), "").when(gap > CELL_GAP * F.greatest(F.lag("size").over(along), "size"), "\x1f").when((gap > SPACE_GAP * F.col("size")) & ~F.lag("text").over(along).rlike(r"\s$") & ~F.col("text").rlike(r"^\s"), " ").otherwise("")
    parts = sided.withColumn("joint", joint)
    whole = parts.groupBy(*PAGE, "row", "side").agg(
        F.array_sort(F.collect_list(F.struct("x", "seq", F.concat("joint", "text").alias("t")))).alias("parts"),
        F.min("x").alias("x0"),
        F.max("end").alias("x1"),
        F.max_by("y", "size").alias("y"),
        F.max_by("size", F.length("text")).alias("size"),
        F.min_by("font", F.struct("x", "seq")).alias("font"),
        F.count_distinct("font").alias("fonts"),
        F.first("page_height").alias("height"),
    )
    cells = F.filter(F.transform(F.split(F.array_join(F.transform("parts", lambda p: p["t"]), ""), "\x1f"), clean_text), lambda c: c != "")
    made = whole.withColumn("cells", cells).where("size(cells) > 0").join(body, "doc_id").join(font, "doc_id", "left")
    return made.select(*PAGE, "side", "x0", "x1", "y", "size", "cells", F.array_join("cells", " | ").alias("text"), ((F.col("fonts") == 1) & (F.col("font") != F.col("body_font"))).alias("distinct_font"), "body_size", "height")


def without_margins(lines_: DataFrame) -> DataFrame:
    """Lines without page numbers, and without those in the margins that repeat on many pages."""
    margin = (F.col("y") > F.col("height") * (1 - MARGIN)) | (F.col("y") < F.col("height") * MARGIN)
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    marked = lines_.withColumn("margin", margin).withColumn("key", key)
    pages = lines_.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    repeats = marked.where("margin").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("on"))
    known = marked.join(pages, "doc_id").join(repeats, ["doc_id", "key"], "left")
    often = (F.col("pages") >= 3) & (F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * REPEATED)))
    return known.where(~(F.col("margin") & (F.trim("text").rlike(PAGE_NUMBER) | F.coalesce(often, F.lit(False))))).select(*lines_.columns)


def titles(lines_: DataFrame) -> DataFrame:
    """doc_id, title: the largest text in the upper part of the first page, if it is much larger than the body."""
    top = lines_.where((F.col("page") == 1) & (F.col("y") > F.col("height") * 0.55)).withColumn("most", F.max("size").over(W.partitionBy("doc_id")))
    large = top.where((F.col("most") >= F.col("body_size") * 1.4) & (F.abs(F.col("size") - F.col("most")) < 0.5))
    joined = large.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("k"), "text"))), lambda s: s["text"]), " ").alias("title"))
    return joined.where(F.length("title").between(10, 250))


def upper_share(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^A-Z]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))), F.lit(0.0))


def fix_small_caps(text: Column) -> Column:
    caps = (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) >= 4) & (upper_share(text) >= 0.8)
    return F.when(caps, F.regexp_replace(text, r"(?<![A-Za-z0-9_])([A-Z]) (?=[A-Z]{2,}(?![A-Za-z0-9_]))", "$1")).otherwise(text)


def heading_level(text: Column, size: Column, body: Column) -> Column:
    dotted = F.regexp_extract(text, r"^(\d{1,2}(?:\.\d{1,2})*)[.)]?\s", 1)
    rest = F.regexp_replace(text, r"^\S+\s*", "")
    return (
        F.when(dotted != "", F.least(F.lit(3), F.size(F.split(dotted, r"\."))))
        .when(text.rlike(r"^[IVXLC]{2,6}\.\s") | (text.rlike(r"^[IVXLC]\.\s") & (upper_share(rest) > 0.8)), 1)
        .when(text.rlike(r"^[A-Z]\.\s"), 2)
        .when(F.trim(text).rlike(SECTION_NAMES) | (size >= body * 1.3), 1)
        .otherwise(2)
    )


def looks_like_heading(gap: Column, leading: Column) -> Column:
    text, size, body = F.col("text"), F.col("size"), F.col("body_size")
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    n_words = F.size(F.split(text, r"\s+"))
    spaced = F.coalesce(gap > leading * 1.2, F.lit(True))
    never = (
        (F.length(letters) < 3) | (F.length(text) > 100) | (F.size("cells") > 1) | (text.rlike("[.,;:]$") & ~text.rlike(r"^[IVXLC]+\.$"))
        | text.rlike(CAPTION) | text.rlike("^[a-z]") | text.rlike(r"(?i)^abstract\s*[—–-]\s*\S")
    )
    capitals = (F.length(letters) >= 4) & (letters == F.upper(letters))
    return ~never & (
        ((size >= body + 1) & (n_words <= 16))
        | ((capitals | fix_small_caps(text).rlike(SECTION_NAMES)) & (n_words <= 6) & spaced)
        | (F.col("distinct_font") & (n_words <= 10) & (spaced | text.rlike(NUMBERED_HEADING)))
        | (text.rlike(NUMBERED_HEADING) & (n_words <= 10) & spaced)
    )


def words_of(lines_: Column) -> Column:
    """The words of lines that stand below each other, in lower case, without what a hyphen at a line's end cuts off."""
    return F.regexp_extract_all(F.lower(lines_), F.lit(r"(?<!\p{L})\p{L}++(?!-(?:\n|\z))"), F.lit(0))


def hyphenated_of(lines_: Column) -> Column:
    """Their words with hyphens within a line."""
    found = F.regexp_extract_all(F.lower(lines_), F.lit(r"(?<!\p{L})\p{L}++(?:-\p{L}++)+"), F.lit(0))
    return F.when(lines_.rlike(rf"-(?<=\p{{L}}{HALF}-)\p{{L}}"), found).otherwise(F.array().cast("array<string>"))


def vocabulary(lines_: DataFrame) -> DataFrame:
    """doc_id, word: the words of each document's lines, hyphenated ones too, once each; what a hyphen at a line's end cuts off is none."""
    lower = F.lower("text")
    words = F.regexp_extract_all(F.regexp_replace(lower, r"\p{L}+-$", ""), F.lit(r"\p{L}+"), F.lit(0))
    both = F.concat(words, F.regexp_extract_all(lower, F.lit(r"\p{L}+(?:-\p{L}+)+"), F.lit(0)))
    return lines_.select("doc_id", F.explode(F.array_distinct(both)).alias("word")).distinct()


def let(value: Column, then) -> Column:
    """then of value, which is worked out once, however often then names it, also for each element of an array."""
    return F.get(F.transform(F.array(value), then), 0)


def told(asked: Column, words: Column) -> Column:
    """The `at` of those of asked (word, at; at above 0) whose word is one of words; in time n log n."""
    none = F.array().cast("array<int>")

    def runs(sorted_: Column) -> Column:
        # a known word, which is at 0, stands before those that ask for it
        starts = F.filter(F.transform(sorted_, lambda x, i: F.when(x["at"] == 0, i + 1)), lambda i: i.isNotNull())

        def run(starts: Column, start: Column, i: Column) -> Column:
            until = F.coalesce(F.get(starts, i + 1), F.size(sorted_) + 1)
            same = F.filter(F.slice(sorted_, start, until - start), lambda x: (x["at"] > 0) & (x["word"] == F.get(sorted_, start - 1)["word"]))
            return F.transform(same, lambda x: x["at"])

        return let(starts, lambda s: F.flatten(F.transform(s, lambda start, i: run(s, start, i))))

    def among(asked: Column, known: Column) -> Column:
        marked = F.transform(known, lambda w: F.struct(w.alias("word"), F.lit(0).alias("at")))
        return F.when(F.size(known) == 0, none).otherwise(let(F.array_sort(F.concat(marked, asked)), runs))

    def met(words: Column) -> Column:
        return F.when(F.size(words) == 0, none).otherwise(let(asked, lambda a: let(F.array_intersect(F.transform(a, lambda x: x["word"]), words), lambda known: among(a, known))))

    return let(words, met)


def free_seam() -> str:
    """The seams where a word may go on in lower case and the parts make no compound by themselves; a part before of more than 64 letters is none of these."""
    one_of = lambda words: "|".join("".join(f"[{c}{c.upper()}{chr(0x212A) if c == 'k' else ''}]" for c in w) for w in words)  # noqa: E731 - as lower() has it
    before = rf"{BEGINS}(?!\p{{L}}*[A-Z]\p{{L}}*[A-Z])(?!(?:{one_of(COMPOUND_PREFIXES)})-)\p{{L}}{{1,64}}"
    return rf"-\n(?=\p{{Ll}})(?!(?:{one_of(COMPOUND_SUFFIXES)})(?!{PART}))(?<={before}-\n)"


def rejoined(lines_: Column, words: Column, hyphenated: Column) -> Column:
    """Lines that stand below each other, in one text without tabs, with the parts of words put together over line ends; other line ends stay.

    words and hyphenated: what the document holds of words, and of words with hyphens, in lower case; words are read only where it depends on them. A hyphen at a line's end goes if the document has
    the two parts as one word, or if a word may go on there in lower case and the parts are no compound: none of the document's, none with capitals or digits before the hyphen, and none with a
    part that makes compounds. A line's part is what stands in that line, also where the line holds nothing else."""

    def seam(above: Column, below: Column) -> Column:
        before, after = F.regexp_extract(above, rf"(?s).*{BEGINS}({PART}++)\z", 1), F.regexp_extract(below, f"^({PART}+)", 1)
        compound = before.rlike("[A-Z].*[A-Z]|[0-9]") | F.lower(before).isin(COMPOUND_PREFIXES) | F.lower(after).isin(COMPOUND_SUFFIXES)
        goes_on = after.rlike(r"^\p{Ll}") & before.rlike(r"\p{L}$")
        return F.struct(F.lower(F.concat(before, after)).alias("one"), F.lower(F.concat(before, F.lit("-"), after)).alias("two"), (goes_on & ~compound).alias("free"))

    def kept(seams: Column, hyphenated: Column) -> Column:
        """The numbers of the hyphens that stay, from 1 on."""
        bound = F.filter(F.transform(seams, lambda s, i: F.when(~s["free"], i + 1)), lambda i: i.isNotNull())
        free = F.filter(F.transform(seams, lambda s, i: F.when(s["free"], F.struct(s["two"].alias("word"), (i + 1).alias("at")))), lambda s: s.isNotNull())
        ones = lambda at: F.transform(at, lambda i: F.struct(F.get(seams, i - 1)["one"].alias("word"), i.alias("at")))
        return let(F.concat(bound, told(free, hyphenated)), lambda at: F.when(F.size(at) == 0, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_except(at, told(ones(at), words)))))

    def put(parts: Column, kept_: Column) -> Column:
        slices = F.zip_with(F.concat(F.array(F.lit(0)), kept_), F.concat(kept_, F.array(F.size(parts))), lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), ""))
        return F.replace(F.array_join(slices, "-"), F.lit("\t"), F.lit(""))

    def met(hyphenated: Column) -> Column:
        # a tab stands for the seams that no word can change
        left = F.when(F.size(hyphenated) == 0, F.regexp_replace(lines_, free_seam(), "\t")).otherwise(lines_)
        seams = lambda parts: F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts) - 1), seam)
        return let(F.split(left, SEAM), lambda parts: let(seams(parts), lambda s: let(kept(s, hyphenated), lambda k: put(parts, k))))

    return let(hyphenated, met)


def dehyphenated(lines_: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, block, text: the lines (doc_id, block, n, text) of each block as one text by `rejoined`; words: doc_id, word.

    A document's lines come together once, and meet its words there."""
    clean = lines_.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''").repartition("doc_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"])  # lines of one block
    blocks = clean.groupBy("doc_id", "block").agg(F.array_join(ordered, "\n").alias("text"))
    documents = blocks.groupBy("doc_id").agg(F.collect_list("block").alias("blocks"), F.array_join(F.collect_list("text"), "\f").alias("lines"))
    held = words.groupBy("doc_id").agg(F.collect_set("word").alias("words"))
    met = documents.join(held, "doc_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    whole = rejoined(F.col("lines"), F.col("words"), F.filter("words", lambda w: F.contains(w, F.lit("-"))))
    texts = F.split(F.replace(whole, F.lit("\n"), F.lit(" ")), "\f")
    return met.select("doc_id", F.inline(F.arrays_zip("blocks", texts.alias("texts")))).toDF("doc_id", "block", "text")


#: Captions and tables between the parts of one paragraph, at most.
BETWEEN = 4


def continued(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block, kind, region, first, last) with `head`, the block that each belongs to, its own where it stands alone.

    A paragraph that is the last prose of its region and ends no sentence goes on in the next prose block, over captions and tables, if that is the first of its own region and begins like the
    middle of a sentence; and on from there, as long as there are no more than BETWEEN of these since its beginning. first and last: the text of the first and the last line."""
    prose = blocks.where(F.col("kind").isin("paragraph", "heading"))
    inside = W.partitionBy("doc_id", "region").orderBy("block")
    own = W.partitionBy("doc_id").orderBy("block")
    numbered_ = blocks.withColumn("skipped", F.count_if(~F.col("kind").isin("paragraph", "heading")).over(own)).select("doc_id", "block", "skipped")
    marked = prose.join(numbered_, ["doc_id", "block"]).withColumns({"opens": F.row_number().over(inside) == 1, "closes": F.lead("block").over(inside).isNull()})
    hangs = (F.col("kind") == "paragraph") & F.col("closes") & ~F.col("last").rlike(r"""[.!?:]["')\]]?$""")
    goes_on = (F.col("kind") == "paragraph") & F.col("opens") & F.col("first").rlike(r"^[\p{Ll}0-9(\[]") & ~F.col("first").rlike(LIST_MARKER)
    linked = marked.withColumn("hangs", hangs).withColumn("linked", goes_on & F.coalesce(F.lag("hangs").over(own), F.lit(False)))
    chained = linked.withColumn("chain", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(own))
    members = chained.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(F.struct("block", "skipped"))).alias("members"))  # parts of one paragraph
    # each begins anew once too much lies between it and the beginning
    start = F.struct(F.get("members", 0).alias("head"), F.array().cast("array<struct<block:bigint, head:bigint>>").alias("told"))

    def tell(state: Column, m: Column) -> Column:
        head = F.when(m["skipped"] - state["head"]["skipped"] <= BETWEEN, state["head"]).otherwise(m)
        return F.struct(head.alias("head"), F.concat(state["told"], F.array(F.struct(m["block"].cast("bigint").alias("block"), head["block"].cast("bigint").alias("head")))).alias("told"))

    heads = members.select("doc_id", F.inline(F.aggregate("members", start, tell)["told"]))
    return blocks.join(heads, ["doc_id", "block"], "left").withColumn("head", F.coalesce("head", "block"))


def read_pages(items: DataFrame) -> DataFrame:
    """doc_id, ord, kind, text, level, page, page_end: the blocks of every document in reading order."""
    kept = without_margins(lines(items))
    named = kept.join(titles(kept), "doc_id", "left")
    kept = written(named.where(~F.coalesce((F.col("page") == 1) & F.contains(F.col("title"), F.col("text")) & (F.col("size") > F.col("body_size") * 1.3), F.lit(False))))
    # reading order: full-width lines part a page into bands; a band is read left, then right
    down = W.partitionBy(*PAGE).orderBy(F.desc("y"), "x0")
    turned = kept.withColumn("turn", F.col("side") == "F")
    changes = (F.lag("turn").over(down).isNull() | (F.lag("turn").over(down) != F.col("turn"))).cast("int")
    banded = turned.withColumn("change", changes).withColumn("band", F.sum("change").over(down))
    region = F.struct("page", "band", F.when(F.col("side") == "R", 1).otherwise(0).alias("column"))
    placed = banded.withColumn("region", region)
    order = W.partitionBy("doc_id").orderBy("region", F.desc("y"), "x0")
    in_region = W.partitionBy("doc_id", "region").orderBy(F.desc("y"), "x0")
    gaps = placed.withColumn("gap", F.lag("y").over(in_region) - F.col("y"))
    usual = gaps.where("gap > 0 AND gap < body_size * 3 AND abs(size - body_size) < 0.6").groupBy(*PAGE, half(F.col("gap")).alias("g")).agg(F.count("*").alias("n"))
    leading = usual.groupBy(*PAGE).agg(F.min_by("g", F.struct((-F.col("n")).alias("n"), "g")).alias("leading"))
    spaced = gaps.join(leading, PAGE, "left").withColumn("leading", F.coalesce("leading", F.col("body_size") * 1.2))
    box = W.partitionBy("doc_id", "region")
    typed = (
        spaced.withColumn("heading", looks_like_heading(F.col("gap"), F.col("leading")))
        .withColumn("kind", F.when(F.col("heading"), "heading").when(F.col("text").rlike(CAPTION), "caption").when(F.size("cells") >= 2, "table").otherwise("paragraph"))
        .withColumn("left", F.min("x0").over(box))
        .withColumn("right", F.max("x1").over(box))
    )
    was = lambda c: F.lag(c).over(order)
    text = F.col("text")
    ends = was("text").rlike(r"""[.!?:]["')\]]?$""")
    short = was("x1") < was("right") - (was("right") - was("left")) * 0.12
    indented = (F.col("x0") > was("x0") + 0.6 * F.col("size")) & text.rlike(r"""^[\p{Lu}\d"“(\[]""")
    moved = was("region") != F.col("region")
    wide = F.coalesce(F.col("gap") > F.col("leading") * 1.45, F.lit(False))
    is_table, was_table = F.col("kind") == "table", was("kind") == "table"
    table_on = was_table & is_table & ~moved & (F.abs(F.size(was("cells")) - F.size("cells")) <= 1)
    caption_on = (was("kind") == "caption") & (F.col("kind") == "paragraph") & ~wide & ~moved
    breaks = (
        was("kind").isNull() | F.col("heading") | (was("kind") == "heading") | (F.col("kind") == "caption")
        | (~table_on & ~caption_on & ((F.abs(was("size") - F.col("size")) > 0.8) | (was_table != is_table) | wide | text.rlike(LIST_MARKER) | (ends & (short | indented)) | (moved & ends & short)))
    )
    # a page's blocks end with it; paragraphs that go on are put together below
    broken = typed.withColumn("breaks", (F.coalesce(breaks, F.lit(True)) | (was("page") != F.col("page"))).cast("int"))
    numbered = broken.withColumn("block", F.sum("breaks").over(order))
    line = F.struct("region", (-F.col("y")).alias("k"), "x0", "text", "cells", "size")
    blocks = numbered.groupBy("doc_id", "block").agg(
        F.array_sort(F.collect_list(line)).alias("lines"), F.min_by("kind", F.struct("region", -F.col("y"))).alias("kind"), F.min("region").alias("region"), F.min("page").alias("page"), F.max("page").alias("page_end"), F.max("size").alias("size"), F.first("body_size").alias("body_size")
    )
    texts = F.transform("lines", lambda s: s["text"])
    table = F.array_join(table_text(F.transform("lines", lambda s: s["cells"])), "\n")
    made = blocks.withColumn("text", F.when(F.col("kind") == "heading", fix_small_caps(F.array_join(texts, " "))).when(F.col("kind") == "table", table).otherwise(F.array_join(texts, " ")))
    tiny = F.col("size") < F.col("body_size") * 0.72
    average = F.length(F.array_join(texts, "")) / F.size("lines")
    sentence = F.col("text").rlike("[.!?:;]") | F.exists(texts, lambda t: F.size(F.split(t, r"\s+")) >= 7)
    label = (F.col("kind") == "paragraph") & (tiny | (F.length(F.regexp_replace("text", r"[^\p{L}]", "")) < 3) | ((average < 28) & ~sentence))
    wordless = (F.col("kind") == "table") & (tiny | ~F.col("text").rlike(r"\p{L}{3}"))
    left = made.where(~label & ~wordless).withColumns({"first": F.get(texts, 0), "last": F.element_at(texts, -1)})
    parted = written(continued(left).drop("first", "last").withColumnRenamed("block", "part").withColumnRenamed("head", "block"))
    prose = parted.where(F.col("kind").isin("paragraph", "caption"))
    whole_lines = prose.select("doc_id", "block", F.posexplode(texts).alias("at", "text"), "part").select("doc_id", "block", F.struct("part", "at").alias("n"), "text")
    joined = dehyphenated(whole_lines, vocabulary(kept)).withColumnRenamed("text", "joined")
    ends = parted.groupBy("doc_id", "block").agg(F.max("page_end").alias("page_end"))
    good = parted.where("part = block").drop("page_end", "part").join(ends, ["doc_id", "block"]).join(joined, ["doc_id", "block"], "left").withColumn("text", F.coalesce("joined", "text")).drop("joined")
    then = F.lead("kind").over(W.partitionBy("doc_id").orderBy("block"))
    kept_heading = F.col("text").rlike(NUMBERED_HEADING) | F.col("text").rlike("(?i)^(abstract|references|bibliography|acknowledg)") | F.coalesce(then.isin("paragraph", "table"), F.lit(False))
    headed = good.withColumn("stays", (F.col("kind") != "heading") | kept_heading).where("stays")
    first_section = F.min(F.when((F.col("kind") == "heading") & (F.col("text").rlike(NUMBERED_HEADING) | F.trim("text").rlike(SECTION_NAMES)), F.col("block"))).over(W.partitionBy("doc_id"))
    front = F.coalesce((F.col("kind") == "heading") & (F.col("page") == 1) & (F.col("block") < first_section), F.lit(False))
    sorted_ = headed.withColumn("kind", F.when(front, "paragraph").otherwise(F.col("kind"))).withColumn("level", F.when(F.col("kind") == "heading", heading_level(F.col("text"), F.col("size"), F.col("body_size"))))
    # "Abstract—We show" is a heading and its paragraph
    start = F.regexp_extract("text", r"^(Abstract|ABSTRACT|Summary)\s*[—–:.-]\s*", 0)
    piece = lambda k, t, lv: F.struct(k.alias("kind"), t.alias("text"), lv.cast("int").alias("level"))
    whole = piece(F.col("kind"), F.col("text"), F.col("level"))
    split = F.when(
        (F.col("kind") == "paragraph") & (start != ""),
        F.array(piece(F.lit("heading"), F.initcap(F.regexp_extract(start, "^[A-Za-z]+", 0)), F.lit(1)), piece(F.col("kind"), F.substring(F.col("text"), F.length(start) + 1, F.lit(1 << 30)), F.lit(None))),
    ).otherwise(F.array(whole))
    out = sorted_.select("doc_id", "block", "page", "page_end", F.posexplode(split).alias("n", "b"))
    return out.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("block", "n")) - 1).alias("ord"), "b.kind", "b.text", "b.level", "page", "page_end")
