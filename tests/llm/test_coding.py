"""Cutting by the standard library's engine, and what coding a batch costs, change no result."""

import gc
import random

import public_tokenizers as P
import regex
import tiktoken

from passagework.llm import bpe


def machine():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.Coder(bpe.rank_vocabulary(file.read()), P.PATTERN)


def odd_texts():
    rng = random.Random(8)
    plane = [chr(n) for n in range(1 << 16) if not 0xD800 <= n < 0xE000]
    rng.shuffle(plane)
    yield "".join(plane)
    yield " ".join(plane)
    yield " \t".join("".join(plane[at : at + 3]) for at in range(0, 30_000, 3))
    signs = "ab'stdmrevl  \n\t\x0b\x1c\x1f\x85  　​09²½٣é漢ª_-.́﻿"
    for _ in range(3_000):
        yield "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
    for _ in range(300):  # with characters beyond these
        yield "".join(rng.choice(signs + "😀𝒜𝟗𠀀") for _ in range(rng.randrange(30)))


def test_pieces_are_those_of_the_pattern():
    cut, full = bpe.cutter(P.PATTERN), regex.compile(P.PATTERN).findall
    for text in odd_texts():
        assert cut(text) == full(text)
    assert bpe.cutter(r"\p{L}+|.")("ab1") == ["ab", "1"]


def test_ids_of_odd_texts_are_the_library_s():
    coder = machine()
    with_pattern = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=coder.machine.ranks, special_tokens={})
    for text in odd_texts():
        ids = coder.encode(text)
        assert ids == with_pattern.encode_ordinary(text)
        assert coder.spelled(ids) == " ".join(map(str, ids))


def test_no_cycles_are_looked_for_while_a_batch_is_coded(monkeypatch):
    monkeypatch.setattr(bpe, "once", lambda *_: None)
    content = type("Shipped", (), {"value": b""})
    made = bpe.each(lambda _, value: (gc.isenabled(), 1 // value), "code", content, P.PATTERN)()
    assert made([1, 2]) == [(False, 1), (False, 0)] and gc.isenabled()
    try:
        made([0])
    except ZeroDivisionError:
        pass
    assert gc.isenabled()
