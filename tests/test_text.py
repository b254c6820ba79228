"""Token functions: Spark columns against their Python twins and plain expectations."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.functions import plain
from passagework.functions import text as T
from passagework.functions import vectors
from passagework.functions.vectors import fnv_buckets
from passagework.operators import search
from passagework.operators.terms import frequencies, term_counts, tokens_of
from passagework.sources import csvio

TEXTS = ["The LiDARs were calibrated using Mid-360 units", "Planned cities, calibration of buses; 0.0143 and OS1-64!", "", "is the a", "Stories missed, misses running agreed lost found", "élan ÜBER straße x1-y2/z3"]


def column(spark, values, make):
    return [r[0] for r in spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string").orderBy("n").select(make(F.col("v"))).collect()]


def test_tokenize_agrees_with_its_twin(spark):
    assert column(spark, TEXTS, T.tokenize) == [plain.tokenize(t) for t in TEXTS]
    assert column(spark, [None], T.tokenize) == [[]]


def test_stems():
    assert [plain.stem(w) for w in "calibrate calibrated calibration planned stories classes lost misses agreed bus".split()] == ["calibrat", "calibrat", "calibrat", "plan", "story", "class", "los", "miss", "agr", "bus"]


def test_fnv(spark):
    words = ["calibrat", "a_b", "", "ünï😀"]
    assert column(spark, words, T.fnv1a)[0] == 378639955
    assert [h % 512 for h in column(spark, words, T.fnv1a)] == fnv_buckets(words).tolist()


@pytest.mark.parametrize(
    ("make", "given_", "wanted"),
    [
        (T.strip_markdown, "# Title\n\n**bold** and `code` with [a link](http://x)\n* item", "Title\n\nbold and code with a link\n- item"),
        (T.title_from_filename, "my_house--rules.v2.pdf", "my house rules.v2"),
        (T.title_from_filename, ".pdf", "Untitled document"),
        (T.display_heading, "III. SYSTEM OVERVIEW OF GPS", "III. System Overview OF GPS"),
        (T.last_heading, "A › B. Sensors", "B. Sensors"),
        (T.cited_source_numbers, "see [2], [1] and [2]; not [1234]", [1, 2]),
        (T.question_error, "  ", "empty"),
        (lambda c: T.file_kind(c, F.lit(None).cast("string")), "a/B.MarkDown", "markdown"),
        (lambda c: T.verify_quote(F.lit("“Quiet  hours”"), c), 'the "quiet hours" begin', True),
        (T.approx_token_count, "12345", 2),
    ],
)
def test_functions(spark, make, given_, wanted):
    assert column(spark, [given_], make) == [wanted]


@pytest.mark.parametrize(
    ("make", "given_", "wanted"),
    [
        (lambda c: T.highlight_offset(c, F.lit("QUIET  hours")), "the  quiet  hours", 5),
        (lambda c: T.highlight_offset(c, F.lit("quiet hours")), "the  quiet  hours", None),
        (T.csv_delimiter, '"a;b;c",d\n;;;;', ","),
        (T.csv_delimiter, "a;b;c,d\r\nx", ";"),
        (T.csv_delimiter, '"open;;;\n,,', ","),
        (T.topic_of, "C. SENSOR CALIBRATION", "sensor calibration"),
        (T.topic_of, "IV. Conclusions", None),
        (T.topic_of, "2.1. ROS Driver for Robots", "ROS driver for robots"),
        (lambda c: T.json_reply(c).cast("string"), 'Sure: {"a": 1} fine', '{"a":1}'),
        (lambda c: T.json_reply(c).cast("string"), "```json\n[1,2]\n```", "[1,2]"),
        (lambda c: T.json_reply(c).cast("string"), "none", None),
        (lambda c: T.reply_fields(c)["citations"][0]["source"], '{"answer": "x", "confidence": "HIGH ", "citations": [{"source": "2", "quote": "q"}]}', 2),
        (lambda c: T.reply_fields(c)["answer"], '{"answer": "x", "confidence": "maybe"}', None),
        (lambda c: T.parse_summary(c)["keyPoints"][0]["text"], '{"keyPoints": [{"text": "t"}], "outline": []}', "t"),
        (lambda c: T.parse_summary(c).isNull(), '{"keyPoints": 3, "outline": []}', True),
        (lambda c: T.format_bytes(F.length(c) * 1_024), "x" * 1_500, "1.46 MB"),
        (lambda c: T.format_ms(F.length(c) * 10), "x" * 125, "1.3 s"),
        (lambda c: T.served_as(c)["type"], "text/html", "application/octet-stream"),
        (lambda c: T.served_as(c)["type"], "text/csv", "text/plain; charset=utf-8"),
        (lambda c: T.file_kind_label(c, F.lit("text/plain")), "notes", "text/plain"),
        (T.stem, "calibrated", "calibrat"),
    ],
)
def test_more_functions(spark, make, given_, wanted):
    assert column(spark, [given_], make) == [wanted]


def test_tables_as_lines_agree_with_their_twin(spark):
    tables = [[["Name", "Price"], ["a", "3"], ["", "4"], ["x", "y", "z"], ["only"]], [["1", "2"], ["3", "4"]], [["  "], ["a"]], [["Name", "Price"]], []]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(tables)], "n int, t array<array<string>>").orderBy("n").select(T.table_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == [csvio.table_lines(t) for t in tables]


def test_delimiters_agree_with_their_twin(spark):
    texts = ["a,b;c\n", "a;b;c", "x\ty\n,,,,", '"a;;;;,",b\r\n', "", '"never closed;;;', "a;b,c"]
    assert column(spark, texts, T.csv_delimiter) == [csvio.detect_delimiter(t) for t in texts]


def test_terms_of_a_table_agree_with_the_column_function(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate([*TEXTS, None])], "n int, v string")
    assert [r["tokens"] for r in tokens_of(rows, "n", F.col("v")).orderBy("n").collect()] == column(spark, [*TEXTS, None], T.tokenize)
    counts = {(r["n"], r["term"]): (r["tf"], r["length"]) for r in term_counts(rows, "n", F.col("v")).collect()}
    assert counts[0, "mid360"] == (1, 7) and {r["term"]: r["df"] for r in frequencies(term_counts(rows, "n", F.col("v"))).collect()}["calibrat"] == 2


def test_vectors_through_bytes(spark):
    rows = spark.createDataFrame([(0, [1.0, -2.5]), (1, None), (2, [])], "n int, v array<float>")
    again = rows.select("n", vectors.bytes_to_vector(vectors.vector_to_bytes(F.col("v"))).alias("v"), vectors.normalize(F.col("v")).alias("u")).orderBy("n").collect()
    assert [r["v"] for r in again] == [[1.0, -2.5], None, []] and abs(again[0]["u"][0] ** 2 + again[0]["u"][1] ** 2 - 1) < 1e-6


def test_zero_scores_stay_in_the_vector_list(spark):
    passages = spark.createDataFrame([(n, t) for n, t in enumerate(["quiet hours begin", "parking permit", "nothing else"])], "n int, v string")
    asked = spark.createDataFrame([(7, "quiet hours"), (8, "zebra")], "q long, v string")
    rows = search.pair_scores(asked, "q", F.col("v"), passages, "n", F.col("v")).collect()
    assert len(rows) == 6 and {r["n"] for r in rows if r["q"] == 8} == {0, 1, 2} and all(r["bm25"] == 0 for r in rows if r["q"] == 8)
    top = search.hybrid(search.pair_scores(asked, "q", F.col("v"), passages, "n", F.col("v")), "q", "n", tuning=search.Tuning(top=1)).collect()
    assert {r["q"]: r["n"] for r in top}[7] == 0


@pytest.mark.parametrize("most", [0, 4_096])
def test_short_quotes_are_found_anywhere(spark, monkeypatch, most):
    monkeypatch.setattr(search, "QUOTE_WORDS", most)
    passages = spark.createDataFrame([(1, "The Quiet  hours begin"), (2, "disquieting"), (3, None)], "n int, v string")
    quotes = spark.createDataFrame([(1, "quiet hours"), (2, "qui"), (3, "t h"), (4, "xy"), (5, None), (6, "the “quiet” hours")], "q int, v string")
    got = {(r["q"], r["n"]) for r in search.quotes_in(quotes, "q", F.col("v"), passages, "n", F.col("v")).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 1)}


def test_pages(spark):
    rows = spark.createDataFrame([(None, None), (4, 4), (4, 5)], "a int, b int").select(T.format_pages(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == ["", "p. 4", "pp. 4–5"]


def test_sentences():
    assert plain.split_sentences("See Fig. 3 for it. J. Smith agreed. Done! Ok") == ["See Fig. 3 for it.", "J. Smith agreed.", "Done!", "Ok"]
    assert plain.split_sentences("As shown in Table I. The rest\nfollows e.g. here.") == ["As shown in Table I.", "The rest", "follows e.g. here."]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcE. !?\n\"’)1", max_size=80))
def test_sentences_keep_all_words(text):
    assert " ".join(plain.split_sentences(text)).split() == text.split()
