"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names, for every operator."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagework.llm import bitslice, bpe, langid, lattice, minhash, mixing, pii, tiles, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["score", "rank", "size", "kept", "component_id", "target", "key", "k0", "m0", "t", "row", "word", "hashes", "copies", "held_out"]
WORDS = "the quick brown fox jumps over the lazy dog and runs far away from here "
ROWS = [
    (1, WORDS * 3, "en", "a", 1),
    (2, WORDS * 3, "en", "a", 1),
    (2, WORDS * 3, "en", "a", 1),  # a repeated row
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, "   \n\t ", "fr", "b", 5),
    (6, "le renard brun saute par dessus le chien paresseux et part bien loin", "fr", "b", None),
    (12, "le chien brun part loin et le renard paresseux saute bien par dessus", "fr", "b", 4),
    (13, "bien loin le renard part et le chien saute par dessus le paresseux", "fr", "b", 4),
    (None, "a text without an id, mail me at x.1@host.example.com now", "en", None, 2),
    (7, WORDS * 4_000, "en", "a", 9),
    (8, "1234 !!! 5678", None, "b", 9),
    (9, "one two", "en", "c", 9),
    (10, "one two", "en", "c", 9),
    (11, "emoji 😀 and ünïcode ﬁ", "de", "c", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


TEXT_OPERATORS = {
    "mix": mixing.mix,
    "count": lambda d: bpe.count_tokens(d, P.path("byte_bpe_50k.json"), P.PATTERN),
    "digests": lambda d: bpe.encode_digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "language": langid.identify,
    "lattice": lambda d: lattice.score_texts(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "minhash": minhash.near_duplicates,
    "pii": pii.find_personal_data,
}


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_every_row_has_a_result(docs, none, name):
    made = TEXT_OPERATORS[name](docs)
    rows = made.collect()
    assert len(rows) == len(ROWS)
    assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r[0] or 0) for r in ROWS)
    empty = TEXT_OPERATORS[name](none)
    assert empty.columns == made.columns and empty.count() == 0


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_defined_results(docs):
    said = by_id(langid.identify(docs))
    assert all(said[n]["lang_pred"] == "und" and said[n]["score"] == 0 for n in (3, 4, 5, 8))
    assert said[6]["lang_pred"] == "fr" and said[7]["lang_pred"] == "en"
    found = by_id(minhash.near_duplicates(docs))
    assert [found[n]["component_id"] for n in (1, 2, 3, 4, 5, 9, 10, None)] == [1, 1, 3, 4, 5, 9, 9, None]
    assert found[3]["n_shingles"] == 0 and found[9]["n_shingles"] == 1 and found[None]["kept"]
    ids = by_id(bpe.encode_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert all(ids[n]["ids_sha256"] == ids[n]["decoded_sha256"] == nothing and ids[n]["n_tokens"] == 0 for n in (3, 4))
    spans = by_id(pii.find_personal_data(docs))
    assert spans[None]["n_email"] == 1 and spans[3]["spans"] == "" and spans[8]["spans"] == ""
    taken = by_id(mixing.mix(docs))
    assert all(taken[n]["taken"] == 0 and taken[n]["size"] == 0 for n in (3, 4, 5))


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1),
        (6, [inf, 1.0], 1), (7, [0.0, 0.0], 1), (8, [], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (50, [-1.0, 0.25, 3.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in CLASH})
    got = [tuple(r) for r in bitslice.top_k(frame).orderBy("query_id", "rank").collect()]
    # both rows of id 1 are candidates
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 9, 65536), (0, 4, 10, 65536), (0, 5, 2, 58880)]
    assert [g[2] for g in got if g[0] == 50] == [7, 8, 2, 0, 1]
    large = spark.createDataFrame([(0, [1.0, 2.0]), (1, [70000.0, -1.0]), (2, [3e30, 0.0]), (3, [0.0, 1.0]), (0, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r)[1:] for r in bitslice.top_k(large).collect()]
    assert (1, 2, 2**63 - 1) in got and (2, 1, 256 * 256 * 70000 - 512 * 256) in got and (1, 3, 0) in got and len(got) == 6
    assert bitslice.top_k(frame.limit(0)).count() == 0
    found = sorted(tiles.near_duplicates(frame).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    assert len(found) == len(rows)
    links = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert links[0] == (3, 0, True) and links[1] == (3, 0, False) and links[2] == (3, 0, False)
    assert all(links[n] == (0, n, True) for n in (3, 4, 5, 6, 7, 8, 9, 10, 50)) and links[None] == (0, None, True)
    assert tiles.near_duplicates(frame.limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://a.net/x"), (2, "https://Sub.Example.NET/en/1?q"), (3, "http://x.org/fr/9#top"), (4, None), (5, ""), (6, "no scheme/en/"), (7, "http://example.com/de/"),
        (8, "http://a.net"), (8, "http://a.net"), (None, "http://b.org/fr/"), (9, "http://x.com/ü/" + "a" * 50_000), (10, "http://evilexample.com/de/"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in CLASH})
    got = urls.judge(frame).collect()
    assert len(got) == len(rows)
    rule = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert rule[1] == ("a.net", "/x", "net/", "block") and rule[2] == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert rule[3][2:] == ("org/fr/", "allow") and rule[7][2:] == ("example.com/de/", "block") and rule[10][2] is None
    assert rule[4] == ("", "", None, "block") and rule[6][:3] == ("", "", None) and rule[8][2] is None
    assert urls.judge(frame.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, none, stage):
    of = dict(corpus_pipeline.STAGES)[stage]
    made = of(spark, docs, "")
    assert of(spark, none, "").count() == 0
    rows = made.collect()
    if stage == "token_ids":
        assert len(rows) == len(ROWS)
        return
    assert made.columns == docs.columns
    ids = [r["doc_id"] for r in rows]
    if stage == "language":
        assert set(ids) >= {1, 2, 6, 7, 9, 10, 11, 12, 13, None} and not {3, 4, 5, 8} & set(ids)
    elif stage == "near_duplicates":  # 7 repeats the shingles of 1
        assert sorted(ids, key=str) == sorted([1, 3, 4, 5, 6, None, 8, 9, 11, 12, 13], key=str)
    elif stage == "personal_data":
        assert len(rows) == len(ROWS) and [r["text"] for r in rows if r["doc_id"] is None] == ["a text without an id, mail me at <EMAIL> now"]
    elif stage == "source_mix":
        assert not {3, 4, 5} & set(ids)
