"""Connected components: right for graphs of any shape, and no step for what is done already."""

import random

from passagework.llm import components as module


def counted(monkeypatch) -> list:
    """A list that grows by one for each table that components() writes."""
    calls, staged = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df: calls.append(1) or staged(df))
    return calls


def found(spark, edges):
    rows = module.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["component"] for r in rows}


def plain(edges):
    root = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a in root and b in root and a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {n: top(n) for n in root}


def test_stars_take_no_step(spark, monkeypatch):
    calls = counted(monkeypatch)
    edges = [(1, n) for n in range(2, 30)] + [(100, 40), (41, 40), (40, 41), (40, 40), (None, 7)]
    assert found(spark, edges) == plain(edges)
    assert len(calls) == 1


def test_a_link_between_stars_takes_two_steps_at_most(spark, monkeypatch):
    calls = counted(monkeypatch)
    edges = [(1, n) for n in range(2, 9)] + [(20, n) for n in range(21, 29)] + [(5, 25)]
    assert found(spark, edges) == plain(edges)
    assert len(calls) <= 3


def test_components_of_chains_trees_and_random_graphs(spark):
    rng = random.Random(3)
    chain = [(n, n + 1) for n in range(40)]
    shuffled = [(a, b) for a, b in zip(*(rng.sample(range(200, 260), 60) for _ in range(2)))]
    some = [(rng.randrange(1_000, 1_200), rng.randrange(1_000, 1_200)) for _ in range(110)]
    edges = chain + shuffled + some + [(-5, -9), (-9, 3_000)]
    assert found(spark, edges) == plain(edges)
    assert found(spark, []) == {}
