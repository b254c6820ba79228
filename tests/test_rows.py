"""Operators that work on all documents or questions at once, held against plain versions that take one at a time."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import answer as A
from passagework.operators import citations, extract, salience
from passagework.operators.chunk import Chunk
from passagework.operators.summary import salient

from . import plain

WORDS = "rent permit parking house quiet hour music office week guest door drill fee month year euro cost number lift water heat".split()


def line(rng, least=3, most=14):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(least, most)))


def test_salience(spark):
    rng = random.Random(1)
    documents = {d: [(line(rng), rng.choice([1.0, 1.25, 1.05])) for _ in range(rng.randrange(0, 15))] for d in range(25)}
    documents[3] = [("same words here now", 1.0)] * 6
    documents[4] = [("the of and", 1.0), ("", 1.0), ("quiet hours", 1.0)]
    documents[5] = [(None, 1.0)]
    rows = [(d, n, t, b) for d, some in documents.items() for n, (t, b) in enumerate(some)]
    got = {}
    for r in salience.salient(spark.createDataFrame(rows, "d int, ord int, text string, bonus double"), "d", 4).collect():
        got.setdefault(r["d"], []).append((r["turn"], r["ord"]))
    for d, some in documents.items():
        assert sorted(n for _, n in got.get(d, [])) == salient([t or "" for t, _ in some], [b for _, b in some], 4), d
        assert [t for t, _ in sorted(got.get(d, []))] == list(range(1, len(got.get(d, [])) + 1))


@pytest.mark.parametrize("limit", [0, 1, 4, 8])
def test_gist(spark, limit):
    rng = random.Random(limit)
    heads = [None, "Abstract", "Paper › Abstract", "1 Introduction", "Results", "V. Conclusions", "Discussion", "References", "Appendix A", "Method"]
    documents = {}
    for d in range(40):
        chunks = [Chunk(n, rng.choice(["Name: x; Price: 3\nName: y; Price: 4", "prose stands here"]), rng.choice(heads), None, None) for n in range(rng.randrange(1, 30))]
        documents[d] = (chunks, [rng.randrange(0, 32) for _ in range(rng.randrange(0, 5))])
    documents[40] = ([Chunk(0, "x", "References", None, None)], [0])
    rows = [(d, c.index, c.content, c.heading, points) for d, (chunks, points) in documents.items() for c in chunks]
    got = {}
    for r in salience.gist(spark.createDataFrame(rows, "d int, chunk_index int, content string, heading string, points array<int>"), ["d"], F.lit(limit)).collect():
        got.setdefault(r["d"], []).append(r["chunk_index"])
    assert {d: sorted(got.get(d, [])) for d in documents} == {d: plain.overview_chunks(chunks, points, limit) for d, (chunks, points) in documents.items()}


def sources_of(rng):
    made = []
    for n in range(rng.randrange(1, 7)):
        text = " ".join(f"{line(rng)}{rng.choice(['', ' 40', ' 7 euros'])}.".capitalize() for _ in range(rng.randrange(0, 8)))
        made.append(A.Source(n + 1, f"d{n}", "t", n, text, rng.choice([None, "Parking fee", "Quiet hours"])))
    return made


QUESTIONS = ["How much is the parking permit fee?", "Explain the quiet hours of music", "What number of guests?", "how do guests use the office door in a week", "zebra", "the of", "", None, "Summarize the document", "What is the rent in euros and the water and heat cost?"]


@pytest.fixture(scope="module")
def asked():
    rng = random.Random(7)
    return [(n, rng.choice(QUESTIONS), sources_of(rng)) for n in range(120)]


def test_extracted_answers(spark, asked):
    questions = spark.createDataFrame([(n, q) for n, q, _ in asked], "id int, q string")
    sources = spark.createDataFrame([(n, s.index, s.heading, s.content) for n, _, some in asked for s in some], "id int, source int, heading string, content string")
    got = {r["id"]: r for r in extract.answers(questions, "id", "q", sources).collect()}
    said = 0
    for n, q, some in asked:
        want = A.answer(q or "", some)
        r = got[n]
        assert (r["answer"], r["confidence"], r["insufficient"]) == (want.text, want.confidence, want.insufficient), (n, q)
        assert [(c["source"], c["quote"]) for c in r["citations"]] == want.citations
        said += not want.insufficient
    assert 20 < said < 120


def test_resolved_citations(spark, asked):
    rng = random.Random(8)
    raw = {}
    for n, _, some in asked:
        quotes = [s.content[:30] for s in some] + ["  QUIET   hour ", "quiet hour", "x", "", None, "“rent”"]
        raw[n] = [(rng.choice([1, 2, 3.0, 0, -1, 1.5, 99, None, float("nan")]), rng.choice(quotes)) for _ in range(rng.randrange(0, 12))]
    rows = spark.createDataFrame([(n, [(None if s is None else float(s), q) for s, q in c]) for n, c in raw.items()], "question_id int, citations array<struct<source:double, quote:string>>")
    sources = spark.createDataFrame([(n, s.index, s.document, s.chunk_index, s.content) for n, _, some in asked for s in some], "question_id int, source int, document_id string, chunk_index int, content string")
    got = {}
    for r in citations.resolved(rows, sources).orderBy("question_id", "ord").collect():
        got.setdefault(r["question_id"], []).append((r["ord"], r["source"], r["document_id"], r["chunk_index"], r["quote"], r["verified"]))
    for n, _, some in asked:
        want = plain.resolve([(s, q or "") for s, q in raw[n] if s == s and s is not None], some)
        assert got.get(n, []) == [(c.order, c.source, c.document, c.chunk_index, c.quote, c.verified) for c in want]
