"""Windows that go through the network together: the same scores as one by one, in a bounded room."""

import tracemalloc
import warnings

import numpy as np
import pytest

from passagework.llm import pii


def block(sizes, seed=4):
    rng = np.random.default_rng(seed)
    codes = rng.integers(1, pii.SYMBOLS, 4_000).astype(np.uint8)
    sizes = np.array(sizes)
    return codes, rng.integers(0, len(codes) - sizes + 1), sizes


@pytest.mark.parametrize("sizes", [[90] * 7, [17] * 3, [5], [90, 90, 61, 33, 33, 1], [512, 1]])
def test_scores_of_a_block_are_those_of_its_windows(sizes):
    network = pii.Network.new(9)
    network.into *= 3  # so that gates and states reach their bounds
    codes, starts, sizes = block(sizes)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        found = network.scores(codes, starts, sizes)
    assert len(found) == len(sizes)
    for x, start, size in zip(found, starts, sizes):
        plain = network.forward(codes[None, start : start + size].astype(int))[0][:, 0]
        assert x.shape == plain.shape and np.allclose(x, plain, atol=1e-4)


def test_a_full_block_keeps_no_states():
    codes, starts, sizes = block([pii.WINDOW] * pii.TOGETHER)
    network = pii.Network.new(9)
    tracemalloc.start()
    network.scores(codes, starts, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = 4 * pii.WINDOW * pii.TOGETHER * pii.TAGS
    assert peak < 4.5 * scores
