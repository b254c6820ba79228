"""The pipeline's stages, one after the other, against plain versions; trained models' outputs are taken as given."""

import collections
import hashlib
import math
import random
import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from passagework.llm import bpe, langid, minhash, pii

FRENCH = "le la maison chien et dans avec pour une table rouge ciel oiseau petit grand jardin".split()
ENGLISH = "the a house dog and in with for one table red sky bird small large garden".split()


def made_rows():
    rng, rows = random.Random(3), []
    for n in range(60):
        words = [rng.choice(FRENCH if n % 3 == 0 else ENGLISH) for _ in range(rng.choice([12, 40, 80]))]
        rows.append([n, words, "fr" if n % 3 == 0 else "en", "abc"[n % 3]])
    rows[10][1] = list(rows[4][1])  # an exact copy, and a near one
    rows[20][1] = [*rows[7][1], "coda"]
    rows[31][1][3:3] = ["mail", "anna.berg@post.example.com", "now"]
    rows[32][1][2:2] = ["call", "+49", "345", "678901"]
    rows[40][1] = ["1234", "5678"]  # no letters
    rows[41][1] = "Это совершенно обычный русский текст о погоде и о людях".split()
    rows[41][2] = None
    rows = [(n, " ".join(w), lang, source, len(" ".join(w))) for n, w, lang, source in rows]
    rows += [rows[50], (None, rows[51][1], "en", "c", 3), (70, None, "en", "a", None), (71, "", None, "b", 0)]
    return rows


def same(rows, wanted):
    return collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, wanted))


def kept_after_dedup(rows):
    sets = {}
    for n, (i, text, *_) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[n] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words and i is not None else set()
    root = list(range(len(rows)))

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for n in sets:
        if rows[n][0] is not None:
            least[top(n)] = min(least.get(top(n), math.inf), rows[n][0])
    kept, seen = [], set()
    for n, row in enumerate(rows):
        if row[0] is None:
            kept.append(row)
        elif row[0] == least[top(n)] and (row[0], row[1]) not in seen:
            seen.add((row[0], row[1]))
            kept.append(row)
    return kept


def mixed_rows(rows):
    def share(text):
        return max(0.05, len(re.sub(r"[\W\d_]+", "", text)) / len(text)) if text else 0.05

    def key(i, text):
        bits = int(hashlib.md5((text or "" if i is None else str(i)).encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / share(text)

    by_source, out = collections.defaultdict(list), []
    for row in rows:
        by_source[row[3]].append((key(row[0], row[1]), row[0], len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")), row))
    sizes = {s: sum(x[2] for x in xs) for s, xs in by_source.items()}
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sorted(sizes))}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        target |= {s: min(2.0 * sizes[s], level * weight[s]) for s in free}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
        if not full or not free:
            break
    for s, xs in by_source.items():
        epochs = target[s] // sizes[s] if sizes[s] else 0
        rest, upto = target[s] - epochs * sizes[s], 0
        for _, _, size, row in sorted(xs, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
            upto += size
            out += [row] * int(min(2, (epochs if size else 0) + (size > 0 and upto - size / 2 <= rest)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(made_rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_plain_versions(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def through(name, docs):
        path = str(tmp_path / name)
        stages[name](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path)

    said = langid.identify(docs, docs.columns, ("held", "said", "score", "known")).collect()
    wanted = [tuple(r)[:5] for r in said if r["said"] != "und" and r["known"] >= corpus_pipeline.LEAST_KNOWN]
    told = through("language", docs)
    assert same(told.collect(), wanted) and not {40, 41, 70, 71} & {r[0] for r in wanted} and {0, 4, 31, None} <= {r[0] for r in wanted}

    single = through("near_duplicates", told)
    assert same(single.collect(), kept_after_dedup(wanted)) and not {10, 20} & {r[0] for r in single.collect()}

    spans = {(r["doc_id"]): r["spans"] for r in pii.find_personal_data(single).collect()}
    clean = through("personal_data", single)

    def redacted(row):
        text = row[1]
        for kind, start, end in sorted((s.split(":") for s in spans[row[0]].split(",") if s), key=lambda s: -int(s[1])):
            text = text[: int(start)] + f"<{kind.upper()}>" + text[int(end) :]
        return (row[0], text, row[2], row[3], len(text))

    assert same(clean.collect(), map(redacted, single.collect()))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "mail <EMAIL> now" in texts[31] and "call <PHONE>" in texts[32]

    mixed = through("source_mix", clean)
    assert same(mixed.collect(), mixed_rows([tuple(r) for r in clean.collect()])) and mixed.count() > clean.count()

    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    ids = lambda t: " ".join(map(str, tik.encode_ordinary(t)))
    final = [(r["doc_id"], r["source"], len(tik.encode_ordinary(r["text"])), hashlib.sha256(ids(r["text"]).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect()]
    made = through("token_ids", mixed)
    assert same([tuple(r[c] for c in ("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")) for r in made.collect()], final)
    assert same(corpus_pipeline.run(spark, folder).collect(), made.collect())


def test_links_that_signatures_rule_out_are_counted(spark, sf):
    """Recall of op7's operator on a driver table: against every pair that shares a shingle, confirmed plainly."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    holders, sets = collections.defaultdict(list), {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower())
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for g in sets[r["doc_id"]]:
            holders[g].append(r["doc_id"])
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), 80).collect()}
    assert len(links) > 10 and all(component[a] == component[b] for a, b in links)
