"""What must hold without caps: repeated rows in a mix, components of any scale, spans of any length, grids of bounded width."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from passagework.llm import bitslice, common, mixing, pii, tiles


def test_mixed_takes_repeated_rows_one_by_one(spark):
    docs = spark.createDataFrame([(None, "one two three", "a", n) for n in range(2_500)] + [(1, "x y", "b", 0)], "doc_id long, text string, source string, name int").repartition(7)
    rows = mixing.mixed(docs).collect()
    a = [r["name"] for r in rows if r["source"] == "a"]
    target = next(r["target"] for r in mixing.mix(docs).where("source = 'a'").collect())
    assert abs(3 * len(a) - target) <= 2
    times = {n: a.count(n) for n in set(a)}
    assert len(times) == 2_500 and set(times.values()) == {1, 2}


def test_mixed_agrees_with_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs).where("copies > 0").collect())
    got = sorted((r["doc_id"], r["count"]) for r in mixing.mixed(docs).groupBy("doc_id").count().collect())
    assert got == want


def test_cosine_links_at_any_scale(spark):
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    vectors = [[x * scale * rng.choice([1.0, 1.3]) for x in v] for v in base for scale in (1.0, 1e200, 1e-200, 1e308 / 4, 5e-324 * 2**20)]
    vectors += [[1e200, 1e200, 0.0, 0.0], [1e200, 1.0001e200, 0.0, 0.0], [1e-200, 1e-200, 0.0, 0.0], [1e-200, 1.0001e-200, 0.0, 0.0], [1e300, 1e-300, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    made = tiles.near_duplicates(spark.createDataFrame([(n, v, 1) for n, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int"))

    def linked(a, b):
        a, b = ([Fraction(x) for x in v] for v in (a, b))
        dot = sum(x * y for x, y in zip(a, b))
        return dot > 0 and dot * dot >= Fraction(93, 100) ** 2 * sum(x * x for x in a) * sum(y * y for y in b)

    links = dict.fromkeys(range(len(vectors)), 0)
    for i, j in itertools.combinations(range(len(vectors)), 2):
        if linked(vectors[i], vectors[j]):
            links[i] += 1
            links[j] += 1
    assert {r["vec_id"]: r["n_links"] for r in made.collect()} == links and links[60] and links[62]


def test_the_grid_is_of_bounded_width():
    for rows in (0, 1, 500, 51_282, 10**7, 10**9):
        blocks, batches, partitions = bitslice.grid(rows, rows // 50, 6)
        assert blocks * bitslice.BLOCK_ROWS >= rows and batches * bitslice.BATCH_ROWS >= rows // 50 and 1 <= partitions <= 4_096
    assert bitslice.grid(51_282, 1_026, 6)[2] >= 12


def test_spans_of_any_length_are_held_against_their_marginals(monkeypatch):
    network = pii.Network.new(1)
    n, start, end = 3_000, 100, 2_500
    scores = np.zeros((n, pii.TAGS), np.float32)
    scores[:, 0] = 30
    scores[start, :], scores[start + 1 : end, :] = 0, 0
    scores[start, 1], scores[start + 1 : end, 2] = 30, 30
    monkeypatch.setattr(pii.Network, "cut_out", lambda self, codes, held, wanted: [scores[s:e].copy() for _, s, e in wanted])
    span = (0, 0, start, end)
    assert network.sure([np.zeros(n, np.uint8)], {0: None}, [span]) == [span]
    scores[1_700] = scores[1_701]
    scores[1_700, 2] = -30
    assert network.sure([np.zeros(n, np.uint8)], {0: None}, [span, (0, 0, start, 1_600)]) == [(0, 0, start, 1_600)]


def test_a_task_drops_what_the_worker_kept_for_other_modules(monkeypatch):
    monkeypatch.setattr(common, "KEPT", {})
    run = cloudpickle.loads(cloudpickle.dumps(common.tidy(lambda parts: parts, "own")))  # as it reaches a worker
    common.KEPT.update({"own": {"a": 1}, "other": {"b": 2}})
    part = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert [p.to_pydict() for p in run(iter([part]))] == [{"x": [1, 2]}]
    assert common.KEPT == {"own": {"a": 1}}
