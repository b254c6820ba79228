"""Text functions as Spark columns: they stay in the JVM and can be pushed and pruned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import GENERAL_SECTION, IRREGULAR, MARKDOWN_MARKS, OVERVIEW_PATTERN, OVERVIEW_WORDS, STOPWORDS, TABLE_LINE

WORD_BREAK, COMPOUND = r"[^\p{L}\p{N}]+", r"[\p{L}\p{N}]+(?:[-./][\p{L}\p{N}]+)+"


def words(text: Column) -> Column:
    """Lower-case words of two characters and more that are no stopwords."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))


def compounds(text: Column) -> Column:
    """Words joined by - . or /, without these."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(COMPOUND), F.lit(0)), lambda c: F.regexp_replace(c, "[-./]", ""))


def _irregular(w: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(F.try_element_at(known, w), w)


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, 1, F.length(w) - n)


def _fixed(w: Column) -> Column:
    return (F.length(w) <= 3) | w.rlike("[0-9]")


def _singular(w: Column) -> Column:
    return (
        F.when(_fixed(w), w)
        .when(w.endswith("ies") & (F.length(w) > 4), F.concat(_cut(w, 3), F.lit("y")))
        .when(w.endswith("sses"), _cut(w, 2))
        .when(w.endswith("s") & ~w.rlike("(ss|us|is)$"), _cut(w, 1))
        .otherwise(w)
    )


def _without_ending(w: Column) -> Column:
    def ends(suffix: str, least: int) -> Column:
        return w.endswith(suffix) & (F.length(w) >= least + len(suffix)) & _cut(w, len(suffix)).rlike("[aeiouy]")

    def single(v: Column) -> Column:
        return F.regexp_replace(v, r"([^aeiouslz])\1$", "$1")

    return F.when(w.rlike("[0-9]"), w).when(ends("ation", 3), F.concat(_cut(w, 5), F.lit("at"))).when(ends("ing", 3), single(_cut(w, 3))).when(ends("ed", 4), single(_cut(w, 2))).otherwise(w)


def _without_e(w: Column) -> Column:
    return F.when((F.length(w) > 3) & w.endswith("e") & ~w.rlike("[0-9]"), _cut(w, 1)).otherwise(w)


def stems(words_: Column) -> Column:
    """Stems of an array of words; one pass a rule, so that no rule repeats the expression of the one before."""
    for rule in (_irregular, _singular, _without_ending, _without_e):
        words_ = F.transform(words_, rule)
    return words_


def stem(word: Column) -> Column:
    return F.element_at(stems(F.array(word)), 1)


def tokenize(text: Column) -> Column:
    """Stems of the words in order, then the compounds; empty for null."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.concat(stems(words(text)), compounds(text)))


def unique_tokens(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def approx_token_count(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4)


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), WORD_BREAK, "")


def normalize_for_match(text: Column) -> Column:
    """Lower case, plain quotes and dashes, single spaces."""
    plain = F.translate(F.lower(text), "‘’‚‛“”„‟‐‑‒–—―− ﻿", "''''\"\"\"\"-------  ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def verify_quote(quote: Column, content: Column) -> Column:
    """Whether a quote of three characters or more stands in the content, both normalised."""
    q = normalize_for_match(quote)
    return F.coalesce((F.length(q) >= 3) & normalize_for_match(content).contains(q), F.lit(False))


def cited_source_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda n: n.cast("int"))))


def _or_null(text: Column) -> Column:
    return F.when(F.length(text) > 0, text)


def contextual_text(title: Column, heading: Column, content: Column) -> Column:
    """"title — heading", a blank line, the content; absent parts are left out."""
    return F.concat_ws("\n\n", _or_null(F.concat_ws(" — ", _or_null(title), _or_null(heading))), content)


def keyword_text(title: Column, heading: Column, content: Column) -> Column:
    return F.concat_ws("\n", _or_null(title), _or_null(heading), content)


def clean_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def question_error(text: Column) -> Column:
    """Error code of a question that can't be asked; else null."""
    clean = clean_question(text)
    return F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, "empty").when(F.length(clean) > 2_000, "too_long")


def title_from_filename(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[_-]+", " "), r"\s+", " "))
    return F.coalesce(_or_null(bare), F.lit("Untitled document"))


def choose_title(detected: Column, filename: Column) -> Column:
    clean = F.trim(detected)
    good = F.length(clean).between(8, 200) & (word_count(clean) >= 2)
    return F.when(good, clean).otherwise(title_from_filename(filename))


def file_kind(filename: Column, mime: Column) -> Column:
    """pdf, docx, text, markdown or csv, by extension, else by MIME type; null for others."""
    by_extension = {"pdf": "pdf", "docx": "docx", "txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "csv": "csv"}
    by_mime = {
        "application/pdf": "pdf",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
        "text/plain": "text",
        "text/markdown": "markdown",
        "text/csv": "csv",
    }
    lookup = lambda known, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key)
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return F.coalesce(lookup(by_extension, extension), lookup(by_mime, F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))))


def format_pages(start: Column, end: Column) -> Column:
    """"p. 4", "pp. 4–5", or "" without pages."""
    one = F.concat(F.lit("p. "), start.cast("string"))
    return F.when(F.coalesce(start, F.lit(0)) == 0, "").when(end.isNotNull() & (end != start) & (end != 0), F.concat(F.lit("pp. "), start.cast("string"), F.lit("–"), end.cast("string"))).otherwise(one)


def file_href(document_id: Column, page: Column) -> Column:
    return F.concat(F.lit("/api/documents/"), document_id, F.lit("/file"), F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("#page="), page.cast("string"))).otherwise(""))


def passage_href(document_id: Column, chunk_index: Column) -> Column:
    return F.concat(F.lit("/documents/"), document_id, F.lit("#s"), (chunk_index + 1).cast("string"))


def last_heading(heading: Column) -> Column:
    return _or_null(F.element_at(F.split(heading, " › "), -1))


def display_heading(heading: Column) -> Column:
    """Sentence case for headings in capitals; Roman numerals and words of three letters stay."""
    letters = F.regexp_replace(heading, "[^A-Za-z]", "")
    softened = F.transform(
        F.split(heading, "(?<=[^A-Za-z0-9_])|(?=[^A-Za-z0-9_])"),
        lambda w: F.when(w.rlike("^[A-Z]{4,}$") & ~w.rlike("^[IVXLC]+$"), F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1_000)))).otherwise(w),
    )
    shouted = (F.length(letters) >= 4) & (letters == F.upper(letters))
    return F.when(shouted, F.array_join(softened, "")).otherwise(heading)


def format_relative(then: Column, now: Column) -> Column:
    """"just now" to "n days ago" within a week, else the date; both in whole seconds of one time zone."""
    ago = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    seconds = now - then
    minutes = F.round(seconds / 60)
    hours = F.round(minutes / 60)
    days = F.round(hours / 24)
    date = F.date_format(F.timestamp_seconds(then), "d MMM yyyy")
    return F.when(seconds < 45, "just now").when(minutes < 60, ago(minutes, "minute")).when(hours < 24, ago(hours, "hour")).when(days == 1, "yesterday").when(days < 7, ago(days, "day")).otherwise(date)


def format_percent(fraction: Column) -> Column:
    return F.concat(F.round(fraction * 100).cast("long").cast("string"), F.lit("%"))


def format_ms(ms: Column) -> Column:
    return F.when(ms < 1_000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.1f", ms / 1_000), F.lit(" s")))


def format_count(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def format_bytes(n: Column) -> Column:
    kb, mb = F.format_string("%.1f", n / 1_024), F.format_string("%.2f", n / 1_048_576)
    return F.when(n < 1_024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1_048_576, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def pluralize(n: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(format_count(n), F.lit(" "), F.when(n == 1, singular).otherwise(plural or singular + "s"))


def file_kind_label(filename: Column, mime: Column) -> Column:
    """The extension in capitals, else the MIME type, else "file"."""
    extension = F.upper(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    return F.coalesce(_or_null(extension), _or_null(mime), F.lit("file"))


def served_as(mime: Column) -> Column:
    """How an original file is handed out: inline only for formats that can't run anything, and any text as plain text."""
    inline = mime.isin("application/pdf", "text/plain", "text/markdown", "text/csv")
    kind = F.when(~F.coalesce(inline, F.lit(False)), "application/octet-stream").when(mime.startswith("text/"), "text/plain; charset=utf-8").otherwise(mime)
    return F.struct(F.when(inline, "inline").otherwise("attachment").alias("disposition"), kind.alias("type"))


def blocks_to_text(blocks: Column) -> Column:
    """The texts of an array of blocks, with a blank line between them."""
    return F.array_join(blocks, "\n\n")


def document_text(title: Column, blocks: Column) -> Column:
    """Title, if there is one, and blocks as one text."""
    return F.concat_ws("\n\n", _or_null(title), blocks_to_text(blocks))


def topic_of(heading: Column) -> Column:
    """What a heading of an outline suggests to ask about: without its number, in lower case but for acronyms; null for general sections."""
    name = F.trim(F.regexp_replace(display_heading(heading), r"^([IVXLC]+|[0-9]+(\.[0-9]+)*|[A-Z])[.)]\s+", ""))
    words_ = F.split(name, r"(?<=[^A-Za-z0-9_])|(?=[^A-Za-z0-9_])")
    plain = F.array_join(F.transform(words_, lambda w: F.when(w.rlike("^[A-Z][a-z]+$"), F.lower(w)).otherwise(w)), "")
    return F.when(F.length(name).between(4, 40) & ~name.rlike("(?i)" + GENERAL_SECTION), plain)


def suggested_questions(n_documents: Column, topics: Column) -> Column:
    """Questions to begin with: two general ones, and one for each of the first two topics."""
    first = F.when(n_documents == 1, "Summarise this document").otherwise("What are these documents about?")
    about = F.transform(F.slice(topics, 1, 2), lambda t: F.concat(F.lit("What does it say about "), t, F.lit("?")))
    return F.concat(F.array(first, F.lit("What are the key findings?")), about)


def progress(done: Column, total: Column) -> Column:
    """Whole percent of a total, 0 of nothing."""
    return F.round(100 * done / F.greatest(F.lit(1), total)).cast("int")


def highlight_offset(content: Column, quote: Column) -> Column:
    """0-based place of the quote in the content as it stands, ignoring case; null if absent."""
    at = F.instr(F.lower(content), F.lower(quote))
    return F.when(at > 0, at - 1)


def json_reply(content: Column) -> Column:
    """The JSON value of a model's reply, as a variant: the whole of it, else what a fence holds, else from the first brace to the last; null if none parses."""
    fence, brace = r"(?is)```(?:json)?\s*(.*?)```", r"(?s)(\{.*\})"
    inside = lambda pattern: F.try_parse_json(F.trim(_or_null(F.regexp_extract(content, pattern, 1))))
    return F.coalesce(F.try_parse_json(_or_null(F.trim(content))), inside(fence), inside(brace))


def reply_fields(content: Column) -> Column:
    """answer, citations, confidence, insufficient of a model's reply, with small liberties put right; null if it is no answer."""
    value = json_reply(content)
    text = lambda path: F.try_variant_get(value, path, "string")
    raw = F.try_variant_get(value, "$.citations", "array<struct<source:string,quote:string>>")
    cited = F.transform(F.coalesce(raw, F.array().cast("array<struct<source:string,quote:string>>")), lambda c: F.struct(c["source"].try_cast("double").try_cast("int").alias("source"), c["quote"].alias("quote")))
    confidence = F.lower(F.trim(text("$.confidence")))
    fields = F.struct(text("$.answer").alias("answer"), cited.alias("citations"), confidence.alias("confidence"), F.coalesce(text("$.insufficient") == "true", F.lit(False)).alias("insufficient"))
    return F.when(text("$.answer").isNotNull() & confidence.isin("high", "medium", "low"), fields)


SUMMARY_TYPE = "struct<abstract:string, keyPoints:array<struct<text:string, chunkIndex:int, page:int>>, outline:array<struct<heading:string, level:int, page:int, chunkIndex:int>>>"


def parse_summary(json: Column) -> Column:
    """A stored summary; null unless it is JSON with key points and an outline."""
    value = F.try_variant_get(F.try_parse_json(json), "$", SUMMARY_TYPE)
    return F.when(value["keyPoints"].isNotNull() & value["outline"].isNotNull(), value)


def table_text(rows: Column) -> Column:
    """A table, an array of arrays of cells, as an array of lines: "Header: value; …" under a header that looks like one, else cells joined by bars."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))), lambda r: F.exists(r, lambda c: c != ""))
    bar = lambda r: F.array_join(F.filter(r, lambda c: c != ""), " | ")
    header = F.try_element_at(clean, F.lit(1))
    numeric = F.size(F.filter(header, lambda c: c.rlike("[0-9]")))
    good = (F.size(clean) >= 2) & F.forall(header, lambda c: F.length(c).between(1, 40)) & (numeric <= F.floor(F.size(header) / 3))
    pairs = lambda r: F.array_join(F.filter(F.zip_with(header, r, lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c))), lambda x: x.isNotNull()), "; ")
    line = lambda r: F.when(F.size(r) == F.size(header), pairs(r)).when(F.size(r) == F.size(header) + 1, F.concat(F.get(r, 0), F.lit(" — "), pairs(F.slice(r, 2, F.size(header))))).otherwise(bar(r))
    return F.when(good, F.concat(F.array(F.array_join(header, " | ")), F.transform(F.slice(clean, 2, F.greatest(F.lit(1), F.size(clean))), line))).otherwise(F.transform(clean, bar))


def csv_delimiter(text: Column) -> Column:
    """The most frequent of comma, semicolon and tab outside quotes in the first line; the earlier one on a tie."""
    line = F.regexp_replace(F.regexp_extract(text, r"^([^\n]*?)\r?(?:\n|$)", 1), '"[^"]*("|$)', "")
    n = {d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in ",;\t"}
    return F.when((n[","] >= n[";"]) & (n[","] >= n["\t"]), ",").when(n[";"] >= n["\t"], ";").otherwise("\t")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the characters' code points, in 64-bit arithmetic."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16_777_619)) % F.lit(4_294_967_296)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2_166_136_261).cast("long"), step)


def is_mostly_table(content: Column) -> Column:
    lines = F.filter(F.split(content, "\n"), lambda x: F.trim(x) != "")
    rows = F.filter(lines, lambda x: x.rlike(TABLE_LINE))
    return (F.size(lines) > 0) & (F.size(rows) * 2 > F.size(lines))


def strip_markdown(text: Column) -> Column:
    """Plain text of Markdown: marks go, their contents stay."""
    for pattern, by in MARKDOWN_MARKS:
        text = F.regexp_replace(text, pattern, by)
    return text


def question_plan(question: Column) -> Column:
    """overview (no topic words), asks (for an overview), and the distinct topic tokens of a question."""
    about = F.array_distinct(tokenize(F.lit(" ".join(OVERVIEW_WORDS))))
    tokens = tokenize(question)
    topic = F.array_except(tokens, about)
    asks = question.rlike("(?i)" + OVERVIEW_PATTERN) | F.arrays_overlap(tokens, about)
    return F.struct((F.size(topic) == 0).alias("overview"), asks.alias("asks"), topic.alias("topic"))


def names_document(plan: Column, title: Column) -> Column:
    """Whether a question that asks for an overview has no topic but words of the title."""
    return plan["asks"] & (F.size(plan["topic"]) > 0) & (F.size(F.array_except(plan["topic"], tokenize(title))) == 0)
