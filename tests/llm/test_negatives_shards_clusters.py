"""Hard negatives, shards and clusters against plain versions in integers of any length, with edge cases."""

import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest

from passagework.llm import clusters, negatives, sharding

VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int, value string, cell string, turn int, cluster string, distance string"
CLASH = ("s", 1, "v", "c", 2, "k", "d")
MOST = 2**63 - 1


def whole(v):
    """floor(256 x) of each component; None for what takes no part."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-(2**62 - 512), min(2**62 - 512, math.floor(256 * x))) for x in v]


def inner(a, b):
    return max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b))))


def test_strassen_is_exact_for_all_shapes():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (9, 9, 9), (33, 17, 65), (64, 64, 64), (50, 64, 101), (13, 100, 7), (0, 5, 3), (20, 0, 20)):
        a, b = rng.integers(-(2**40), 2**40, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
        assert (negatives.strassen(a, b) == a @ b).all()
        exact = negatives.strassen(a.astype(object) * 10**30, b.astype(object))
        assert exact.shape == (m, n) and (not k or (exact == (a.astype(object) * 10**30) @ b.astype(object)).all())


def test_products_of_long_vectors_end_at_64_bits():
    rng = random.Random(2)
    size = lambda: rng.choice([1, 300, 2**20, 2**31, 2**45, 2**61])
    a, b = ([[rng.randint(-s, s) for _ in range(19)] for s in (size() for _ in range(60))] for _ in range(2))
    got = negatives.products(np.array(a, np.int64), np.array(b, np.int64))
    assert got.tolist() == [[inner(x, y) for y in b] for x in a]


def test_heaps_merge_in_any_order():
    rng = random.Random(3)
    entries = [(rng.randrange(4), rng.choice([-MOST, -3, 0, 1, 2, 5, MOST]), i) for i in range(300)]
    want = sorted((o, -s, i) for o in range(4) for s, i in sorted(((s, i) for p, s, i in entries if p == o), key=lambda x: (-x[0], x[1]))[:7])
    for parts in (1, 3, 50):
        heaps = negatives.Heaps(4, 7)
        rng.shuffle(entries)
        for n in range(parts):
            other = negatives.Heaps(4, 7)
            some = entries[n::parts]
            for o, s, i in some:
                row = np.full((1, 2), negatives.NONE)
                row[0, 0] = s
                other.offer(o, row, np.array([i, 10_000]))
            heaps.merge(*other.entries())
        assert sorted((int(o), -int(s), int(i)) for o, s, i in zip(*heaps.entries())) == want


def plain_negatives(rows, every=100, positives=5, negatives_=10, low=30, high=90):
    rows = [(i, lab, whole(v)) for i, v, lab in rows]
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    out = []
    for anchor, label, vector in sorted({(i, lab, tuple(v)) for i, lab, v in rows if i % every == 0}):
        scored = sorted((-inner(vector, v), i, lab) for i, lab, v in rows if i != anchor)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and -low * p <= -100 * s[0] <= -high * p][:negatives_]
            out += [(anchor, pid, rank, nid, -p, -n) for rank, (n, nid, _) in enumerate(inside, 1)]
    return sorted(out)


def got_negatives(spark, rows, **options):
    table = spark.createDataFrame([(*r, *CLASH) for r in rows], VECTORS).repartition(3)
    made = negatives.hard_negatives(table, **options)
    return sorted(tuple(r) for r in made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def awkward(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.random()]) for _ in range(dims)], rng.randrange(3)) for i in range(n)]
    rows += [(5, None, 1), (6, [1.0, None] + [0.0] * (dims - 2), 1), (7, [math.nan] * dims, 1), (8, [math.inf] * dims, 0), (None, [0.1] * dims, 1), (9, [0.1] * dims, None)]
    rows += [rows[0], rows[0], rows[10], (0, [0.3] * dims, 2), (n, [], 0), (n + 1, [1.0] * (dims + 3), 1), (n + 2, [0.5] * 3, 2)]  # repeats, and unequal lengths
    return rows


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "STRIP_ROWS", 3)
    monkeypatch.setattr(negatives, "TILE_ROWS", 16)
    monkeypatch.setattr(negatives, "BATCH_ROWS", 7)
    monkeypatch.setattr(negatives, "CELL_ROWS", 40)
    rows = awkward(220, 5, 4)
    want = plain_negatives(rows, every=10)
    assert got_negatives(spark, rows, every=10) == want and len(want) > 100


def test_hard_negatives_of_ties_and_large_components(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(40)] + [(100 + i, [0.5 + i % 3 * 0.1, 0.0], 5) for i in range(30)]
    rows += [(200, [1e30, -1e30], 0), (201, [1e9, 1e9], 0), (202, [3e8, 1e9], 1), (203, [-1e200, 0.0], 1)]
    assert got_negatives(spark, rows, every=20) == plain_negatives(rows, every=20)


def test_hard_negatives_of_no_rows_and_of_one(spark):
    assert got_negatives(spark, []) == [] == got_negatives(spark, [(100, [1.0], 1)])


def test_hard_negatives_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    made = negatives.op11_hard_negatives(spark, sf)
    assert sorted(tuple(r) for r in made.collect()) == plain_negatives(rows)
    assert made.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


def plain_shards(texts, shards=8):
    """Shard by text: bundles and large groups, by a search for the least load each time."""
    load = {}
    for t in texts:
        load[t or ""] = load.get(t or "", 0) + len((t or "").encode()) + 1
    total, items, item_of = sum(load.values()), {}, {}
    for t, n in load.items():
        digest = hashlib.sha256(t.encode()).hexdigest()
        first = int(digest[:3], 16)
        level = 12 - max(1, first.bit_length())
        item_of[t] = digest if n * sharding.PARTS >= total else f"{level}-{int(digest[3:6], 16) % sharding.BUNDLES}"
        items[item_of[t]] = items.get(item_of[t], 0) + n
    loads, shard = [0] * shards, {}
    for item in sorted(items, key=lambda i: (-items[i], i)):
        shard[item] = loads.index(min(loads))
        loads[shard[item]] += items[item]
    return {t: shard[i] for t, i in item_of.items()}, loads


DOCS = "doc_id long, text string, size string, shard string, slot string, digest string, bundle string, task string"


@pytest.mark.parametrize("parts", [20_000, 40])
def test_shards_by_a_plain_schedule(spark, monkeypatch, parts):
    monkeypatch.setattr(sharding, "PARTS", parts)
    rng = random.Random(5)
    texts = [None, "", "", None, "é😀", "x" * 5_000, "x" * 5_000, *["y" * 300] * 400] + ["".join(rng.choice("abc ") for _ in range(rng.randrange(200))) for _ in range(900)]
    ids = [None, None, 3, 3, *range(4, len(texts))]
    docs = spark.createDataFrame([(i, t, *"abcdef") for i, t in zip(ids, texts)], DOCS).repartition(5)
    rows = sharding.sharded(docs).collect()
    assert len(rows) == len(texts)
    want, _ = plain_shards(texts)
    by_row = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, want[t or ""]) for i, t in zip(ids, texts))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"], r["shard"]) for r in rows) == by_row
    for shard in range(8):
        own = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        key = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in own]
        assert key == sorted(key)


def test_shards_are_near_equal_and_repeat(spark, sf):
    made = [sorted(tuple(r) for r in sharding.op12_shards(spark, sf).collect()) for _ in range(2)]
    assert made[0] == made[1]
    loads = {}
    for r in sharding.op12_shards(spark, sf).collect():
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert sorted(loads) == list(range(8)) and max(loads.values()) - min(loads.values()) <= 0.001 * sum(loads.values())


def test_a_third_of_all_rows_in_one_text_and_one_id(spark):
    docs = spark.range(0, 3_000, 1, 6).selectExpr("if(id < 1000, 7, id) AS doc_id", "if(id < 1000, 'same', concat('text ', id)) AS text")
    rows = sharding.sharded(docs, 4).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] == 7 and r["text_crc32"] == zlib.crc32(b"same")}) == 1
    for shard in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(loads) - min(loads) <= 20


def test_the_heap_finds_the_least_load():
    rng = random.Random(6)
    items = [(f"i{n}", rng.randrange(1, 50)) for n in range(500)]
    loads, want = [0] * 5, {}
    for item, load in sorted(items, key=lambda x: (-x[1], x[0])):
        want[item] = min(range(5), key=lambda s: (loads[s], s))
        loads[want[item]] += load
    assert sharding.scheduled(items, 5) == want and heapq.nsmallest(1, loads)


def test_shards_of_no_rows(spark):
    made = sharding.sharded(spark.createDataFrame([], DOCS))
    assert made.count() == 0 and made.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == dims and whole(v) is not None]
    ordered = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in ordered[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        centroids = [[sum(x) // len(some) for x in zip(*some)] if (some := [v for (_, v), o in zip(kept, own) if o == c]) else old for c, old in enumerate(centroids)]
    out, inertia = [], {}
    for i, v in kept:
        c = nearest(v)
        d = min(MOST, apart(v, centroids[c]))
        inertia[c] = inertia.get(c, 0) + d
        out.append((i, c, d))
    total = min(MOST, sum(inertia.values()))
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i, c, d, min(MOST, inertia[c]), total, sha(c)) for i, c, d in out), key=repr)


def got_clusters(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 0, *CLASH) for i, v in rows], VECTORS).repartition(3)
    return sorted((tuple(r) for r in clusters.clustered(table, **options).collect()), key=repr)


def test_clusters_by_brute_force(spark):
    rows = [(i, v) for i, v, _ in awkward(150, 5, 7)]
    want = plain_clusters(rows, 12, 4, 5)
    assert got_clusters(spark, rows, k=12, rounds=4, dims=5) == want and len({w[1] for w in want}) > 5


def test_clusters_of_ties_and_large_components(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(60)]
    assert got_clusters(spark, grid, k=9, rounds=3, dims=2) == plain_clusters(grid, 9, 3, 2)
    rng = random.Random(8)
    large = [(i, [rng.choice([1.0, 1e6, 1e9, 1e15, -1e300]) * rng.random() for _ in range(3)]) for i in range(80)]
    assert got_clusters(spark, large, k=7, rounds=3, dims=3) == plain_clusters(large, 7, 3, 3)


def test_clusters_of_few_rows_and_of_none(spark):
    few = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [9.0, 9.0]), (3, [1.0]), (4, None)]
    assert got_clusters(spark, few, k=40, rounds=5, dims=2) == plain_clusters(few, 40, 5, 2)
    assert got_clusters(spark, [], dims=2) == [] == got_clusters(spark, [(None, [1.0, 2.0])], dims=2)


def test_clusters_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in clusters.op13_centroid_clusters(spark, sf).collect()), key=repr) == plain_clusters(rows, 40, 5, 64)
