"""The stored index against plain scores, blocks that are left out, and what leaves a task."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework.functions.plain import tokenize
from passagework.functions.vectors import embedded
from passagework.operators import index as I
from passagework.operators import search as S

WORDS = [f"word{n}x" for n in range(60)]


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(700)]
    # what the rare words stand in comes first, so later blocks can't reach it
    texts[:12] = [f"needle needle needle haystack thread {WORDS[n]}" for n in range(12)]
    return [(f"p{n:04}", t) for n, t in enumerate(texts)] + [("empty", ""), ("null", None)]


QUESTIONS = [(1, "needle in the haystack with word1x"), (2, "word2x word3x word4x"), (3, None), (4, "nothing known"), (5, "thread")]


def plain_scores(passages):
    tokens = {k: tokenize(t or "") for k, t in passages}
    mean = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for some in tokens.values() for t in set(some))
    idf = lambda t: math.log(1 + (len(tokens) - df[t] + 0.5) / (df[t] + 0.5))
    out = {}
    for q, text in QUESTIONS:
        terms = list(dict.fromkeys(tokenize(text or "")))
        near = embedded([tokenize(text or "")])[0]
        for k, some in tokens.items():
            tf = Counter(some)
            bm25 = sum(idf(t) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(some) / mean)) for t in terms if tf[t])
            total = sum(map(idf, terms))
            held = sum(idf(t) for t in terms if tf[t]) / total if total else 0.0
            out[q, k] = {"bm25": round(bm25, 6), "coverage": round(held, 6), "vector_score": round(min(1.0, float(near @ embedded([some])[0])), 6)}
    return out


def first(scores, q, name, n):
    rows = [(-s[name], k) for (p, k), s in scores.items() if p == q and (name == "vector_score" or s[name] > 0)]
    return [k for _, k in sorted(rows)[:n]]


@pytest.fixture(scope="module")
def built(spark, passages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    I.build(spark.createDataFrame(passages, "k string, t string").repartition(5), "k", F.col("t"), path=path)
    return I.read(spark, path)  # the texts are gone


def test_lists_come_from_the_stored_index(spark, passages, built):
    asked = spark.createDataFrame(QUESTIONS, "q int, v string")
    want = plain_scores(passages)
    rows = {(r["q"], r["k"]): r for r in I.search(built, asked, "q", F.col("v"), "k", dict.fromkeys(I.LISTS, 9), 1.2, 0.75).collect()}
    for q, _ in QUESTIONS:
        for name in I.LISTS:
            got = [k for _, k in sorted((-r[name], k) for (p, k), r in rows.items() if p == q and (name == "vector_score" or r[name] > 0))[:9]]
            assert got == first(want, q, name, 9)
    for key, r in rows.items():
        assert {n: r[n] for n in I.LISTS} == pytest.approx(want[key], abs=2e-6)


def test_one_list_alone(spark, passages, built):
    asked = spark.createDataFrame(QUESTIONS, "q int, v string")
    found = I.search(built, asked, "q", F.col("v"), "k", {"bm25": 4}, 1.2, 0.75)
    assert found.where("vector_score IS NOT NULL").isEmpty()
    top = S.ranked(found, "q", F.desc("bm25"), F.col("k"), at_most=4).orderBy("q", "rank").collect()
    want = plain_scores(passages)
    assert [(r["q"], r["k"]) for r in top] == [(q, k) for q, _ in QUESTIONS for k in first(want, q, "bm25", 4)]


def test_a_task_gives_no_more_than_its_heaps_hold(spark, built):
    asked = spark.createDataFrame(QUESTIONS, "q int, v string")
    found = I.search(built, asked, "q", F.col("v"), "k", {"bm25": 3, "vector_score": 3}, 1.2, 0.75)
    by_task = found.groupBy(F.spark_partition_id().alias("task"), "q").count().collect()
    assert by_task and all(r["count"] <= 6 for r in by_task)


def test_blocks_that_cannot_reach_the_last_score_are_left_out(passages):
    asked = I.Asked([1], ["needle haystack word1x"])
    tokens = [tokenize(t or "") for _, t in passages]
    df = Counter(t for some in tokens for t in set(some))
    asked.weigh(len(tokens), sum(map(len, tokens)), {n: df[t] for t, n in asked.number.items()}, 1.2, 0.75)
    scored, heap = [], {"bm25": I.Best(1, 5)}
    for at in range(0, len(tokens), 20):
        some = tokens[at : at + 20]
        length = np.array([len(t) for t in some])
        p = I._postings(some, length, 0)
        held = [n for n, t in enumerate(p["term"]) if t in asked.number]
        hits = [{"no": asked.number[p["term"][n]], "most": int(p["most"][n]), "least": float(p["least"][n]), "n": int(p["n"][n]), "places": p["places"][n].as_py(), "counts": p["counts"][n].as_py()} for n in held]
        block = {"keys": pa.array([[k for k, _ in passages[at : at + 20]]])[0], "lengths": pa.array([length.tolist()])[0], "hits": pa.array([hits], I_HITS)[0]}
        scored.append(I.offer(asked, heap, block))
    assert scored[0] and sum(scored) < len(scored) / 3  # most hold word1x only
    want = sorted((-sum(asked.gain(np.array([n]), np.array([c]), np.array([len(some)]))[0] for t, n in asked.number.items() if (c := some.count(t))), k) for some, (k, _) in zip(tokens, passages))[:5]
    assert heap["bm25"].key[0].tolist() == [k for _, k in want]


I_HITS = pa.list_(pa.struct([("no", pa.int32()), ("most", pa.int32()), ("least", pa.float64()), ("n", pa.int32()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))


def test_both_lists_are_fused_in_one_shuffle(spark, passages, built):
    asked = spark.createDataFrame(QUESTIONS, "q int, v string")
    tuning = S.Tuning(depth=9)
    scores = I.search(built, asked, "q", F.col("v"), "k", {"bm25": 9, "vector_score": 9}, 1.2, 0.75)
    want = plain_scores(passages)
    got = {(r["q"], r["k"]): r["score"] for r in S.both_lists(scores, "q", "k", tuning).collect()}
    for q, _ in QUESTIONS:
        expected = Counter()
        for name in ("vector_score", "bm25"):
            for rank, k in enumerate(first(want, q, name, 9), 1):
                expected[k] += 61 / (60 + rank) / 2
        assert {k: s for (p, k), s in got.items() if p == q} == pytest.approx(dict(expected))
    top = S.hybrid(spark.createDataFrame(scores.collect(), scores.schema), "q", "k", tuning=tuning)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(q") == 1


def test_rankings_fuse(spark):
    ranking = lambda keys: spark.createDataFrame([(1, k, n) for n, k in enumerate(keys, 1)], "q int, k string, rank int")
    got = {r["k"]: r["score"] for r in S.fuse([ranking("ab"), ranking("bc"), ranking("b")], "q", "k").collect()}
    assert got == pytest.approx({"a": 1 / 3, "b": (61 / 62 + 1 + 1) / 3, "c": 61 / 62 / 3})
