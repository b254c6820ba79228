"""Paragraphs over captions and columns, and words over line ends, against plain versions and by hand."""

import hashlib
import random
import re
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from passagework.functions.constants import COMPOUND_PREFIXES, COMPOUND_SUFFIXES
from passagework.operators import layout
from passagework.plans.details import layout_dehyphenated
from passagework.plans.details_sql import DETAILS


def plain_text(lines, words):
    """The lines of one block, given the document's words and hyphenated words."""
    lines = [t for t in (" ".join(x.split()) for x in lines) if t]
    out = lines[:1]
    for before, line in zip(lines, lines[1:]):
        a, z = re.search(r"([^\W_]+)-$", before), re.match(r"[^\W_]+", line)
        if not (a and z):
            out.append(" " + line)
            continue
        a, z = a[1], z[0]
        compound = re.search("[A-Z].*[A-Z]|[0-9]", a) or a.lower() in COMPOUND_PREFIXES or z.lower() in COMPOUND_SUFFIXES
        goes_on = z[0].islower() and a[-1].isalpha()
        if (a + z).lower() in words or (goes_on and f"{a}-{z}".lower() not in words and not compound):
            out[-1] = out[-1][:-1]
        out.append(line)
    return "".join(out)


def test_words_over_line_ends(spark):
    rng = random.Random(3)
    parts = ["re-", "producible", "Li-", "DAR", "lidar", "multi-", "UAV", "Mid-", "360", "3D-", "printed", "low-", "cost", "low-cost", "a line", "ends", "well-", "known", "GNSS-", "denied", "time-based", "time-", "based", "", "über-", "all"]
    documents = {f"d{d}": {b: [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 4))) for _ in range(rng.randrange(1, 9))] for b in range(3)} for d in range(60)}
    rows = [(d, b, n, t) for d, blocks in documents.items() for b, lines in blocks.items() for n, t in enumerate(lines)]
    frame = spark.createDataFrame(rows, "doc_id string, block int, n int, text string")
    got = {(r["doc_id"], r["block"]): r["text"] for r in layout.dehyphenated(frame, layout.vocabulary(frame)).collect()}
    for d, blocks in documents.items():
        words = set()
        for text in (t.lower() for lines in blocks.values() for t in lines):
            words.update(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)+", text))
            words.update(re.findall(r"[^\W\d_]+", re.sub(r"[^\W\d_]+-$", "", text)))
        for b, lines in blocks.items():
            assert got.get((d, b), "") == plain_text(lines, words), lines


def broken_and_joined(text):
    """A text in lines of 40 characters, put together again, with nothing but letters, hyphens and spaces in it."""
    pieces = [text[i : i + 40] for i in range(0, len(text), 40)]
    lines = [" ".join((a + "-" if a[-1].isalpha() and z[:1].isalpha() else a).split()) for a, z in zip(pieces, [*pieces[1:], ""])]
    words = {w for x in map(str.lower, lines) for w in [*re.findall("[a-z]+(?:-[a-z]+)+", x), *re.findall("[a-z]+", re.sub("[a-z]+-$", "", x))]}
    return plain_text(lines, words)


def documents_in(path, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), f"{path}/documents.parquet")
    return str(path)


def test_odd_texts_are_put_together_as_the_sql_says(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", " ", "\n \n", "\t", "\t" * 90, "x" * 39 + "\r" + "yz", "x" * 39 + "\u2028" + "yz", "\u00a0", "ab " * 13 + "\u00a0cd", "x" * 35 + "foo- bar foo foobar", "-" * 90, "a-" * 90, "A" * 90, "\U0001d49c" * 90, "ab" + " " * 38 + "\t" * 40 + "cd", ("x" * 39 + "-" + "y" * 39 + "-") * 5]
    rng = random.Random(11)
    parts = ["low-cost", "lowcost", "re-use", "reuse", "LiDAR", "LIDAR", "GNSS-denied", "3D-printed", "foo-", "über-alles", "überalles", "x2y", "\U0001d49c\U0001d4b7c", "\t", "\r", "  ", "\n", "\u00a0", "\x85", "a_b", "well", "known", "中文", "½x"]
    bare = ["low", "LOW", "Cost", "semi", "co", "baseD", "LiDAR", "1\U0001d49cb", "b\U0001d49c", "\U0001f600foo", "known", "liKe", "li\u212ae", "\u017ftate", "state", "é", "ÉA", "ª", "中", "БВ", "3D", "9", "a", "B", "order"]
    for n in range(800):
        own = rng.sample(bare if n % 2 else parts, rng.randrange(2, 12))
        texts.append("".join(rng.choice(own) + rng.choice([" ", "", "-"]) for _ in range(rng.choice([5, 40, 120]))))
    got = sorted(tuple(r) for r in layout_dehyphenated(spark, documents_in(tmp_path, texts)).collect())
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        assert got == sorted(base.execute(DETAILS["layout_dehyphenated"]).fetchall())


@pytest.mark.parametrize("kind", ["prose", "capitals", "hyphens"])
def test_one_long_text_is_put_together_in_time(spark, tmp_path, kind):
    """Work that grows with a text's length, not with its square; capitals and hyphens have to be looked up."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60 if kind == "hyphens" else 50_000)]
    text = " ".join(rng.choice(vocabulary) + (rng.choice(["", "-" + rng.choice(vocabulary)]) if kind == "hyphens" else "") for _ in range(400_000))
    text = text.upper() if kind == "capitals" else text
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = [tuple(r) for r in layout_dehyphenated(spark, documents_in(tmp_path, [text])).collect()]
    finally:
        late.cancel()
    want = broken_and_joined(text)
    assert got == [(0, len(want), hashlib.md5(want.encode()).hexdigest())]


def plain_heads(blocks):
    """Which block each belongs to, by a walk from each paragraph over what follows."""
    prose = [b for b in blocks if b["kind"] in ("paragraph", "heading")]
    ends = {b["region"]: b["block"] for b in prose}
    starts = {b["region"]: b["block"] for b in reversed(prose)}
    heads = {b["block"]: b["block"] for b in blocks}
    left = list(blocks)
    at = 0
    while at < len(left):
        a, part = left[at], left[at]
        while part["kind"] == "paragraph" and ends[part["region"]] == part["block"] and not re.search(r"""[.!?:]["')\]]?$""", part["last"]):
            near = [b for b in left[at + 1 : at + 6]]
            b = next((b for b in near if b["kind"] not in ("caption", "table")), None)
            if b is None or b["kind"] != "paragraph" or starts[b["region"]] != b["block"] or not re.match(r"[a-z0-9(\[]", b["first"]):
                break
            heads[b["block"]] = a["block"]
            left.remove(b)
            part = b
        at += 1
    return heads


def test_paragraphs_go_on_over_captions(spark):
    rng = random.Random(4)
    documents = {}
    for d in range(150):
        region, blocks = 0, []
        for n in range(rng.randrange(1, 25)):
            region += rng.random() < 0.5
            blocks.append({"block": n, "kind": rng.choice(["paragraph"] * 5 + ["caption", "caption", "table", "heading"]), "region": region, "first": rng.choice(["and so", "on it goes", "Then", "7 of"]), "last": rng.choice(["goes on", "and", "ends."])})
        documents[f"d{d}"] = blocks
    rows = [(d, b["block"], b["kind"], b["region"], b["first"], b["last"]) for d, blocks in documents.items() for b in blocks]
    made = layout.continued(spark.createDataFrame(rows, "doc_id string, block long, kind string, region int, first string, last string")).collect()
    got = {(r["doc_id"], r["block"]): r["head"] for r in made}
    merged = 0
    for d, blocks in documents.items():
        want = plain_heads(blocks)
        assert {b: got[d, b] for b in want} == want, blocks
        merged += sum(h != b for b, h in want.items())
    assert merged > 50


def test_a_page_with_a_caption_between(spark):
    rows, seq = [], 0

    def put(page, text, x, y, size=10.0, font="body"):
        nonlocal seq
        seq += 1
        rows.append(("d", page, seq, text, float(x), float(y), len(text) * size * 0.45, size, font, 600.0, 800.0))

    for n in range(8):
        put(1, f"the left column has words that go on {n} and multi-" if n == 7 else f"the left column has words that go on here {n}", 40, 640 - 12 * n)
        put(1, "Figure 1: what is shown there." if n == 0 else f"the right column has words too {n} here", 320, 640 - 12 * n - (30 if n else 0))
    put(2, "and the next page begins in the middle of it all.", 40, 640)
    fields = "doc_id string, page int, seq int, text string, x double, y double, w double, size double, font string, page_width double, page_height double"
    got = layout.read_pages(spark.createDataFrame(rows, fields)).orderBy("ord").collect()
    assert [r["kind"] for r in got].count("caption") == 1
    body = [r for r in got if r["kind"] == "paragraph"]
    assert len(body) == 1 and body[0]["page"] == 1 and body[0]["page_end"] == 2
    assert "go on 7 and multi-the right column has words too 1 here" in body[0]["text"]
    assert body[0]["text"].endswith("in the middle of it all.")
