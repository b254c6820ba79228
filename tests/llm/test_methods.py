"""Every operator against a plain version, a library, or held-out labels, on the smallest driver tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from passagework.llm import bitslice, bpe, langid, lattice, minhash, mixing, pii, tiles
from passagework.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def content(name):
    with open(P.path(name), "rb") as file:
        return file.read()


def awkward(n, seed=1):
    rng = random.Random(seed)
    tokens = [t.decode(errors="replace") for t in bpe.rank_vocabulary(content("byte_bpe_50k.tiktoken"))]
    alphabet = "aaaabcdeeefhinorstu  \n\t'.,0123456789-éèñüß中日😀 "
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    made += ["".join(rng.choice(tokens) for _ in range(6)) for _ in range(n)]
    return made + ["a" * k for k in range(200)] + [" " * k + "x" for k in range(40)] + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", ""]


def test_machines_agree_with_the_libraries():
    ranks = bpe.rank_vocabulary(content("byte_bpe_50k.tiktoken"))
    coder = bpe.Coder(ranks, P.PATTERN)
    counter = bpe.Counter(*[bpe.json_vocabulary(content("byte_bpe_50k.json"))[0]], P.PATTERN, bpe.json_vocabulary(content("byte_bpe_50k.json"))[1])
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = awkward(3_000)
    lengths = [len(e.ids) for e in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(made, add_special_tokens=False)]
    for text, n in zip(made, lengths):
        ids = coder.encode(text)
        assert ids == tik.encode_ordinary(text) and coder.decode(ids) == text and counter.count(text) == n


def test_chunk_maps_compose(monkeypatch):
    ranks, added = bpe.json_vocabulary(content("byte_bpe_50k.json"))
    counter = bpe.Counter(ranks, P.PATTERN, added)
    tricky = ["it's they're we've I'll I'd 'tis 're'", "a'r b'v c'l 'r 'x ''s !'s", "a  b\n\n c \t d\u00a0\u00a0e  ", "'", " '", "'l", "  ", "x" * 700 + " y", "\n" * 300 + "z", "1 22  333'4", "é'é ’s 中 文"]
    texts = awkward(400, seed=2) + tricky
    for text, whole in zip(texts, [len(e.ids) for e in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]):
        for size in (1, 2, 3, 17, 8_192):  # 1 cuts at every character
            monkeypatch.setattr(bpe, "CHUNK_CHARS", size)
            assert counter.count(text) == whole, (text, size)


def test_chunk_maps_know_entry_states_and_are_associative(monkeypatch):
    ranks, added = bpe.json_vocabulary(content("byte_bpe_50k.json"))
    counter = bpe.Counter(ranks, P.PATTERN, added)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    text = "It's a line of words, cut anywhere; the maps don't mind. " * 20
    maps = counter.maps(text)
    assert all(len(m.known) == 1 for m in maps)  # before any is composed
    state, total = bpe.START, 0
    for m in maps:
        assert state in m.known  # as expected
        state, n = m(state)
        total += n
    a, b, c = maps[:3]
    entry = next(iter(a.known))
    assert bpe.Composed(bpe.Composed(a, b), c)(entry) == bpe.Composed(a, bpe.Composed(b, c))(entry)
    prefixes = counter.scan(maps)
    assert prefixes[-1](bpe.START) == (state, total) and len(prefixes) == len(maps)
    assert all(len(m.known) == 1 for m in maps)


def test_long_pieces_keep_memory_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 2_000)
    rng = random.Random(5)
    piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    ranks = bpe.rank_vocabulary(content("byte_bpe_50k.tiktoken"))
    coder, counter = bpe.Coder(ranks, P.PATTERN), bpe.Counter(ranks, P.PATTERN)
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = tik.encode_ordinary(piece)
    assert coder.encode(piece) == ids and counter.count(piece) == len(ids)
    assert len(coder.machine.states) < 2_000 + bpe.RUN_BYTES + 2 and len(counter.machine.states) < 2_000 + bpe.RUN_BYTES + 2
    assert not any(len(p) > bpe.LONGEST_KEPT for p in (*coder.pieces, *counter.pieces))


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    ranks = bpe.rank_vocabulary(content("byte_bpe_50k.tiktoken"))
    coder, tik = bpe.Coder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(coder.encode(t) == tik.encode_ordinary(t) for t in awkward(200, seed=3))


def test_utf8_stream():
    data = "aé中😀z".encode()
    for size in range(1, 6):
        stream = bpe.Utf8Stream()
        parts = [stream.feed(data[n : n + size]) for n in range(0, len(data), size)]
        assert "".join([*parts, stream.feed(b"", last=True)]) == data.decode() and stream.valid
    broken = bpe.Utf8Stream()
    broken.feed(b"\xe4\xb8")
    assert broken.feed(b"", last=True) == "�" and not broken.valid


def test_token_queries(spark, sf, texts):
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_vocabulary(content("byte_bpe_50k.tiktoken")), special_tokens={})
    count = {r["doc_id"]: r for r in QUERIES["op3_token_counts"](spark, sf).collect()}
    for r in QUERIES["op4_byte_bpe"](spark, sf).collect():
        text = texts[r["doc_id"]]["text"]
        ids = tik.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["valid_utf8"]
        assert (count[r["doc_id"]]["n_tokens"], count[r["doc_id"]]["n_bytes"], count[r["doc_id"]]["over_limit"]) == (len(ids), len(text.encode()), len(ids) > 1024)


def test_top_k_of_blocks():
    rng = np.random.default_rng(0)
    for rows, dims, spread in ((300, 16, 3), (130, 5, 200), (64, 1, 1), (1, 4, 9)):
        ids, values = rng.permutation(rows * 3)[:rows].astype(np.int64), rng.integers(-spread, spread + 1, (rows, dims))
        block = bitslice.Block.load(**bitslice.Block(ids, values).dump())
        for weights in rng.integers(-spread, spread + 1, (20, dims)):
            plain = sorted(zip((-(values @ weights)).tolist(), ids.tolist()))
            assert block.best(weights, 5) == [(-s, i) for s, i in plain[:5]]
            but = int(ids[rng.integers(rows)])
            assert block.best(weights, 5, but) == [(-s, i) for s, i in plain if i != but][:5]


@pytest.mark.parametrize("dims", [3, 64, 768])
def test_embedding_links_against_all_pairs(spark, dims, monkeypatch):
    monkeypatch.setattr(tiles, "FEWEST", 10)
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(30, min(dims, 40))) @ rng.normal(size=(min(dims, 40), dims))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * rng.uniform(0, 0.5, (30, 1)) * np.abs(base).mean(), base[:5]]).astype(np.float32)
    y = x.astype(np.float64)
    cosine = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
    near = (cosine >= 0.93) & ~np.eye(len(x), dtype=bool)
    found = tiles.near_duplicates(spark.createDataFrame([(n, v.tolist(), 1) for n, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()
    root = tiles.forest(len(x), *np.nonzero(near))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {n: (int(near[n].sum()), int(root[n])) for n in range(len(x))} and near.any()


def test_suffix_bound_ends_most_products():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 30)) * 0.9 ** np.arange(30) @ np.linalg.qr(rng.normal(size=(768, 30)))[0].T
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ tiles.leading_axes(x)
    assert turned.shape[1] == tiles.LEADING and np.allclose((turned[:, : tiles.LEADING] ** 2).sum(axis=1), 1)
    rest = np.sqrt(np.maximum(0, 1 - (turned[:, : tiles.STEP] ** 2).sum(axis=1)))
    alive = turned[:, : tiles.STEP] @ turned[:, : tiles.STEP].T + np.outer(rest, rest) >= 0.93
    assert alive.mean() < 0.02
    a, b = tiles.linked(x, x, turned, turned, 0.93)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(n.tolist() for n in np.nonzero(unit @ unit.T >= 0.93))))


def test_mix_ranges_hold_about_as_many_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 100)
    docs = spark.range(20_000).selectExpr("IF(id < 5000, NULL, id) AS doc_id", "concat(id, ' ', repeat('7 ', id % 50)) AS text", "IF(id % 3 = 0, 'a', 'b') AS source")
    rows = mixing.ranged(docs.select(*mixing.sized(docs, mixing.text_quality(docs["text"]))))  # all but no letters: quality 0.05
    counts = [r["count"] for r in rows.groupBy("no_source", "name", "part").count().collect()]
    assert max(counts) < 200 and len(counts) > 150


def test_mixed_rows_are_those_that_mix_takes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    assert dict(collections.Counter(r["doc_id"] for r in mixing.mixed(docs).collect())) == taken


def test_mix_takes_repeated_rows_one_by_one(spark):
    docs = spark.createDataFrame([(None, "one two three", "a")] * 2_500 + [(1, "x y", "b")], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 2_501
    a = [r for r in rows if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 2 and {r["copies"] for r in a} == {1, 2}


def test_mix_targets_and_budgets(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    sizes = {r["source"]: r["source_size"] for r in rows}
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sorted(sizes))}
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while free:  # excess over twice the size is shared again
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] if s in full else share * weight[s] for s in free}
        left -= sum(2 * sizes[s] for s in full)
        free = free - full if full else set()
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_language_held_out(docs, texts):
    said = [r for r in langid.identify(docs).collect() if r["held_out"]]
    right = [r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in said]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)


def test_lattice_against_enumeration():
    coder = bpe.Coder({bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}, P.PATTERN)
    chance = np.log(np.full(259, 1 / 259))
    chance[[256, 257, 258]] = np.log([0.1, 0.2, 0.05])
    pieces = {t: math.exp(chance[i]) for i, t in coder.machine.bytes_of.items()}

    def total(word):
        return 1.0 if not word else sum(p * total(word[len(t) :]) for t, p in pieces.items() if word.startswith(t))

    words = [b"", b"a", b"ab", b"abc", b"abcabc", b"xabcbca", b"bb"]
    assert np.allclose(np.exp(lattice.Lattice(coder, chance).score(words)), [total(w) for w in words])


def test_lattice_document_scores(spark):
    """Against counts, chances and sums over all segmentations written plainly, with the vocabulary's real ranks."""
    rows = [(n, t) for n, t in enumerate(["the cat sat", "The cat ran, the cat ran", "a cat", None, "", "dog dog catdog", "sat on the mat the cat", "ran", "mat cat", "zebra the", "cat"])] + [(None, "the cat"), (None, "the dog"), (4, "the cat")]
    ranks = bpe.rank_vocabulary(content("byte_bpe_50k.tiktoken"))
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces, ends = collections.Counter(), 0
    for n, t in rows:
        if zlib.crc32(b"" if n is None else str(n).encode()) % 10:
            ends += 1
            for w in (t or "").lower().split():
                pieces.update(ranks[b] for b in tik.decode_tokens_bytes(tik.encode_ordinary(" " + w)))
    mass = sum(pieces.values()) + ends + lattice.PSEUDO * (len(ranks) + 1)

    def chance(word):
        sums = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            sums[end] = sum(sums[start] * (pieces[ranks[word[start:end]]] + lattice.PSEUDO) / mass for start in range(end) if word[start:end] in ranks)
        return sums[-1]

    want = sorted(math.log10((ends + lattice.PSEUDO) / mass) + sum(math.log10(chance(b" " + w.encode())) for w in (t or "").lower().split()) for _, t in rows)
    got = sorted(r["score"] for r in lattice.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9)


def test_language_scores_against_a_plain_kernel_machine():
    """Kernel values by sets of n-grams, and ridge regression in its dual form over the same landmarks."""
    texts = ["the cat sat on a mat", "the dog ran to the cat", "a bird on the tree", "le chat est sur la table", "la maison et le chien", "un oiseau dans le ciel"]
    labels, marks = ["en"] * 3 + ["fr"] * 3, [0, 1, 3, 4]
    sets = [set(np.concatenate(list(langid.grams(t))).tolist()) for t in texts]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    folded = " ".join(texts[0].split())
    plain = {f" {folded} "[k : k + n] for n in range(1, 5) for k in range(len(folded) + 3 - n)}
    assert abs(len(sets[0]) - len(plain)) <= 2  # but for places that collide

    bits = np.packbits(langid.presence(texts)[0].astype(bool), axis=1)
    before, langid.LANDMARKS = langid.LANDMARKS, 2
    try:
        model = langid.fit(bits, labels)
    finally:
        langid.LANDMARKS = before
    rows = langid.presence(texts)[0]
    assert np.allclose(model.kernel(rows), kernel[:, marks], atol=1e-6)
    values, axes = np.linalg.eigh(kernel[np.ix_(marks, marks)] + 1e-6 * np.eye(4))
    features = np.hstack([kernel[:, marks] @ (axes / np.sqrt(np.maximum(values, 1e-6)) @ axes.T), np.ones((6, 1))])
    targets = np.array([[1, -1] if x == "en" else [-1, 1] for x in labels], float)
    scaled = features * math.sqrt(1 / 3)  # each row weighs one by the rows of its language
    dual = scaled.T @ np.linalg.solve(scaled @ scaled.T + langid.RIDGE * np.eye(6), targets * math.sqrt(1 / 3))
    assert np.allclose(model.scores(model.kernel(rows)), features @ dual, atol=2e-3)
    cut = langid.PIECE
    try:
        langid.PIECE = 7
        assert all((langid.presence([t])[0] == langid.presence([t])[0]).all() for t in texts)
        short = langid.presence(texts)[0]
    finally:
        langid.PIECE = cut
    assert (short == rows).all()


def test_lattice_base_scores(spark, sf, texts):
    counts, ends = collections.Counter(), 0
    for n, r in texts.items():
        if zlib.crc32(str(n).encode()) % 10:
            counts.update(r["text"].encode().lower().split())
            ends += 1
    tokens, distinct = sum(counts.values()) + ends, len(counts) + 1
    of = lambda c: math.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1)))
    for r in QUERIES["op6_lattice_score"](spark, sf).collect():
        words = texts[r["doc_id"]]["text"].encode().lower().split()
        assert r["train_tokens"] == tokens and r["n_tokens"] == len(words) + 1 and r["n_known"] == 1 + sum(counts[w] > 0 for w in words)
        assert math.isclose(r["base_score"], of(ends) + sum(of(counts[w]) for w in words), rel_tol=1e-9) and -math.inf < r["score"] < 0


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_at_the_threshold(spark, percent):
    rng, rows = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    for group in range(40):
        base = [word() for _ in range(rng.choice([6, 12, 60, 300]))]
        for copy in range(6):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 50))):
                text[rng.randrange(len(text))] = word()
            rows.append((group * 10 + copy, rng.choice([" ", "\n "]).join(text).upper()))
    sets = {}
    for n, text in rows:
        words = text.lower().split()
        sets[n] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {n: n for n in sets}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    found = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert {n: r["component_id"] for n, r in found.items()} == {n: top(n) for n in sets}
    assert all(r["n_shingles"] == len(sets[n]) for n, r in found.items())


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plainly_detected(text):
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(digits))) % 10 == 0
            if (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and luhn, 8 <= len(digits) <= 15)[kind]:
                yield kind, m.start(), m.end()


def test_detectors_agree_with_the_patterns(texts):
    rng = random.Random(2)
    made = ["".join(rng.choice("aB1234567890..@@-- +()%_é\n") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    for text in [*made, *(r["text"] for r in texts.values())]:
        assert pii.detected(text) == list(plainly_detected(text))


@pytest.fixture(scope="module")
def network():
    return pii.fit([], 5)


def windows_of(lines):
    x, y = np.zeros((len(lines), pii.TRAINED), np.int64), np.zeros((len(lines), pii.TRAINED), np.int64)
    for n, (text, spans) in enumerate(lines):
        x[n, : len(text)], y[n, : len(text)] = pii.symbols(text), pii.tags(len(text), spans, 0)
    return x, y


def test_network_learns_spans_it_has_not_seen(network):
    held = pii.made_windows(200, seed=99)
    got = network.read([t for t, _ in held])
    wanted = [[s for s in spans if s[2] <= len(t)] for t, spans in held]
    right = sum(len(set(a) & set(b)) for a, b in zip(got, wanted))
    assert right >= 0.7 * sum(map(len, wanted)) and right >= 0.8 * sum(map(len, got))


def test_network_gradient_by_finite_differences():
    x, y = windows_of(pii.spelled_windows(6, seed=3))
    x, y = x[:, :20], y[:, :20]
    network = pii.Network.new(3, np.float64)
    network.moves += np.random.default_rng(0).normal(0, 0.3, network.moves.shape)

    def loss():
        scores = network.forward(x)[0]
        path = sum(scores[t, np.arange(len(x)), y[:, t]] + network.moves[y[:, t - 1] if t else pii.TAGS, y[:, t]] for t in range(x.shape[1]))
        return float((network.marginals(scores)[0] - path).mean())

    rng = np.random.default_rng(1)
    for values, slopes in zip(network.parameters(), network.gradient(x, y)):
        for _ in range(12):
            at = tuple(rng.integers(n) for n in values.shape)
            before, tiny = values[at], 1e-6
            values[at] = before + tiny
            more = loss()
            values[at] = before - tiny
            less = loss()
            values[at] = before
            assert math.isclose((more - less) / (2 * tiny), slopes[at], rel_tol=1e-3, abs_tol=1e-6)


def test_crf_by_enumeration():
    rng = np.random.default_rng(4)
    network = pii.Network.new(1, np.float64)
    network.moves[:] = rng.normal(0, 1, network.moves.shape)
    x = rng.normal(0, 1, (4, 1, pii.TAGS))
    paths = list(itertools.product(range(pii.TAGS), repeat=4))
    value = np.array([sum(x[t, 0, p[t]] + network.moves[p[t - 1] if t else pii.TAGS, p[t]] for t in range(4)) for p in paths])
    total, chance, expected = network.marginals(x)
    weight = np.exp(value - value.max())
    weight /= weight.sum()
    assert math.isclose(total[0], np.log(np.exp(value - value.max()).sum()) + value.max())
    for t in range(4):
        assert np.allclose(chance[t, 0], np.bincount([p[t] for p in paths], weight, pii.TAGS))
    plain = np.zeros_like(expected)
    for p, w in zip(paths, weight):
        for a, b in zip((pii.TAGS, *p), p):
            plain[a, b] += w
    assert np.allclose(expected, plain)
    none = np.zeros(pii.TAGS)
    assert tuple(network.decode([x[:, 0]], [pii.TAGS], [none])[0]) == paths[int(value.argmax())]
    across = network.across(x[None, :, 0])[0]
    for a in range(pii.TAGS):
        of = {}
        for p in paths:
            of[p[-1]] = max(of.get(p[-1], -np.inf), sum(x[t, 0, p[t]] + network.moves[p[t - 1] if t else a, p[t]] for t in range(4)))
        assert np.allclose(across[a], [of[b] for b in range(pii.TAGS)])


def test_network_reads_every_character_and_its_direct_form_agrees(network, monkeypatch):
    class Seen(pii.Network):
        def scores(self, codes, starts, sizes):
            made = super().scores(codes, starts, sizes)
            for s, n, scores in zip(starts, sizes, made):
                seen[s : s + n] = 1
                plain = self.forward(codes[None, s : s + n].astype(np.int64))[0][:, 0]
                assert np.allclose(scores, plain, atol=1e-3)
            return made

    text = "a line without signs or numbers. " * 40 + "ab" * 40
    codes = pii.symbols(text)
    seen = np.zeros(len(codes))
    Seen(*network.parameters()).averaged([codes])
    assert seen.all()


def test_long_texts_are_decoded_as_in_one_piece(network, monkeypatch):
    rng = random.Random(6)
    lines = [t for t, _ in (*pii.spelled_windows(150, seed=8), *pii.made_windows(150, seed=9))]
    text = " ".join(lines) + "".join(rng.choice("0123456789 -") for _ in range(3_000)) + " ".join(lines[:40])
    whole = network.read([text, text[:100], ""])
    monkeypatch.setattr(pii, "PIECE", pii.STRIDE * 4)
    monkeypatch.setattr(pii, "BLOCK", 8)
    pieces = network.read([text, text[:100], ""])
    assert len(whole[0]) > 60 and pieces == whole


def test_best_path_is_that_of_the_whole_text(network):
    """Against a plain Viterbi without regions."""
    for text in [" ".join(t for t, _ in pii.spelled_windows(40, seed=s)) for s in range(5)]:
        codes = pii.symbols(text)
        x = network.averaged([codes])[0]
        best, back = network.moves[-1] + x[0], []
        for row in x[1:]:
            ways = best[:, None] + network.moves[:-1]
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = np.array(path[::-1])
        places = network.open_places(*network.gains(x, True))
        assert path.any() and not path[~places].any()
        got = np.zeros(len(codes), int)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], places, [0]])))
        for _, start, tags in network.paths([codes], {0: x}, [(0, int(s), int(e)) for s, e in edges.reshape(-1, 2)]):
            got[start : start + len(tags)] = tags
        assert (got == path).all()


def test_network_finds_spelled_out_data_and_whole_addresses(network):
    held = pii.spelled_windows(600, seed=99)
    got = [spans for _, spans in ((b, [s for s in e if s not in b]) for b, e in pii.find([t for t, _ in held], network))]
    wanted = [[s for s in spans if s[1] >= 0 and s[2] <= len(t)] for t, spans in held]
    plain = [n for n, (t, _) in enumerate(held) if not pii.MARKS.search(t)]
    right = sum(len(set(got[n]) & set(wanted[n])) for n in plain)
    assert right >= 0.6 * sum(len(wanted[n]) for n in plain) > 0
    assert right >= 0.6 * sum(len(got[n]) for n in plain)
    assert pii.widened(0, "to " + "a" * 80 + ".b@host, or", 60, 90) == (3, 90)
    assert pii.widened(3, "+49 345 6789012 now", 0, 12) == (0, 15)
    assert pii.plausible(3, "+٤٩ ٣٤٥ ٦٧٨٩٠١٢") and not pii.plausible(0, "Rotation")


def test_added_spans_reach_the_query(spark):
    rows = [(1, "please write to jane dot berg at mail dot org or to anton at blue dot net today"), (2, "call plus four nine three four five six seven eight nine zero one now"), (3, "the train is late at the station and nobody knows why"), (4, None)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_added"] + got[2]["n_added"] > 0 and got[3]["n_added"] == got[4]["n_added"] == 0
    assert got[1]["n_email"] == 0 and (got[1]["spans"] + got[2]["spans"]).count(":") == 2 * (got[1]["n_added"] + got[2]["n_added"])
