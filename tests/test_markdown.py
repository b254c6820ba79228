"""Markdown read as windows over lines, against the reader of one text, and by hand."""

import random

from pyspark.sql import functions as F

from passagework.sources import native, readers

PIECES = ["# Head", "### Deep ##", "words here", "*more* `words`", "", "  ", "===", "---", "----", "- item", "2) item [x](http://y)", "| a | b |", "|---|:-:|", "| c |", "```", "```py", "> quoted", "Title of it", "**", "====", "*", "text | bar"]


def test_windows_say_what_the_reader_says(spark):
    rng = random.Random(11)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(1_500)]
    texts += ["A\n===\nB\n===\nC\n---\nd", "x\nA\n===\nB\n===", "===\n===\n===", "| a |\n```\ncode\n```\n# H", "| a |\n```\ncode\n```\n\nend", "| a |\n```\nc\n```\n| b |", "﻿# T\r\nx\ry", "", "- a\n---\nb"]
    rows = native.markdown_blocks(spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4), "k", F.col("t")).orderBy("k", "ord").collect()
    got = {}
    for r in rows:
        assert r["ord"] == len(got.setdefault(r["k"], []))
        got[r["k"]].append((r["kind"], r["text"], r["level"]))
    for n, text in enumerate(texts):
        assert got.get(n, []) == [(b.kind, b.text, b.level) for b in readers.markdown_blocks(text)], text


def test_by_hand(spark):
    text = "# A *b* ##\n\none\ntwo **three**\n\nUnder\n-----\n- x\n- y\nrest\n| K | V |\n|---|---|\n| a | 1 |\n```\n# code\n```\nend"
    want = [("heading", "A b", 1), ("paragraph", "one two three", None), ("heading", "Under", 2), ("paragraph", "- x", None), ("paragraph", "- y", None), ("paragraph", "rest", None), ("table", "K | V\nK: a; V: 1", None), ("paragraph", "# code end", None)]
    made = native.markdown_blocks(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", F.col("t"))
    got = [(r["kind"], r["text"], r["level"]) for r in made.orderBy("ord").collect()]
    assert got[:-1] == want[:-1] and got[-1][1] in ("code end", "# code end")
    titles, rest = native.with_titles(made, "k")
    assert [r["title"] for r in titles.collect()] == ["A b"] and rest.count() == len(got) - 1
    assert readers.read("markdown", text.encode())[0] == "A b"
