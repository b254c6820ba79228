"""Readers, CSV, passages, summaries and answers on small documents of our own."""

import io
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.operators import answer as A
from passagework.operators.chunk import Options, chunk_blocks
from passagework.operators.summary import salient, summarize
from passagework.sources import csvio, readers
from passagework.sources.readers import Block

from . import plain

RULES = """# House rules

## Parking

A parking permit costs 40 euros a month. Permits are issued by the office on weekdays. Guests may park for two hours.

## Quiet hours

Quiet hours start at 22:00 and end at 7:00. Music must be kept low during that time.

- keep doors closed
- no drilling
"""


def test_markdown():
    title, blocks = readers.read("markdown", RULES.encode())
    assert title == "House rules"
    assert [(b.kind, b.level) for b in blocks] == [("heading", 2), ("paragraph", None), ("heading", 2), *[("paragraph", None)] * 3]
    table = readers.markdown_blocks("| Item | Price |\n| --- | :-: |\n| Tea | 2 |\n\nOver\n====\ntext")
    assert [(b.kind, b.text) for b in table] == [("table", "Item | Price\nItem: Tea; Price: 2"), ("heading", "Over"), ("paragraph", "text")]


def test_text_html_docx():
    assert [(b.kind, b.level) for b in readers.text_blocks("INTRO\n\nSome text here.\nMore.\n\n- a\n- b")] == [("heading", 1), ("paragraph", None), ("paragraph", None)]
    html = "<h2>A &amp; B</h2><p>x<br>y &#65;&zzz;</p><ul><li>one</li></ul><table><tr><th>K</th><th>V</th></tr><tr><td>a</td><td>b</td></tr></table>"
    assert [b.text for b in readers.html_blocks(html)] == ["A & B", "x y A&zzz;", "- one", "K | V\nK: a; V: b"]
    data = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(data, "w") as file:
        file.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:p><w:r><w:t>Words of it.</w:t></w:r></w:p></w:body></w:document>')
    assert [(b.kind, b.text, b.level) for b in readers.docx_blocks(data.getvalue())] == [("heading", "Part", 2), ("paragraph", "Words of it.", None)]
    for kind, content in (("text", b"short"), ("docx", b"nonsense"), (None, b"x" * 99)):
        try:
            readers.read(kind, content)
            raise AssertionError
        except readers.ReadError:
            pass


def test_csv():
    assert csvio.parse('a;"b;""c"\r\n\r\n1;2\n') == [["a", 'b;"c'], ["1", "2"]]
    assert csvio.questions([["id", "Question"], ["1", " Why  so? "], ["2", ""]]) == ["Why so?"]
    assert csvio.write([["=1", 'a"b', "c,d"]]) == "'=1,\"a\"\"b\",\"c,d\"\r\n"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='ab",;\n x', max_size=6), min_size=2, max_size=3), min_size=1, max_size=4))
def test_csv_round_trip(rows):
    kept = [r for r in rows if any(c.strip() for c in r)]
    assert csvio.parse(csvio.write(rows, protect=False), ",") == kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(60, 400))
def test_chunks_cover_and_fit(sizes, most):
    sentences = [f"S{n} " + " ".join(f"w{k}" for k in range(size)) + "." for n, size in enumerate(sizes)]
    chunks = chunk_blocks([Block("paragraph", " ".join(sentences))], Options(most, 0, 1))
    assert all(len(c.content) <= most for c in chunks)
    text = " ".join(c.content for c in chunks)
    assert all(word in text for s in sentences for word in s.split()[:1])


def test_chunk_sections():
    _, blocks = readers.read("markdown", RULES.encode())
    whole = chunk_blocks(blocks)
    assert len(whole) == 1 and "Quiet hours" in whole[0].content
    parts = chunk_blocks(blocks, Options(min_chars=0))
    assert [c.heading for c in parts] == ["Parking", "Quiet hours"]


def test_answers():
    _, blocks = readers.read("markdown", RULES.encode())
    chunks = chunk_blocks(blocks, Options(min_chars=0))
    sources = [A.Source(n, "d", "House rules", c.index, c.content, c.heading) for n, c in enumerate(chunks, 1)]
    got = A.answer("How much does a parking permit cost?", sources)
    assert got.text.startswith("A parking permit costs 40 euros a month. [1]") and not got.insufficient
    assert A.answer("Who repairs the elevator cable?", sources).insufficient
    cited = plain.resolve([(1, "a parking PERMIT costs 40 euros"), (1, "A parking permit costs 40 euros"), (3, "x"), (1.5, "y"), (2, "not there")], sources)
    assert [(c.source, c.verified) for c in cited] == [(1, True), (2, False)]
    assert A.plan("Summarize the document").overview and A.plan("parking fee").topic == ["park", "fee"]
    said = A.overview(sources)
    assert "[1]" in said.text and said.confidence == "medium"


def test_salience_and_overview():
    texts = ["Cats chase mice at night.", "Cats chase mice at night time.", "The market opened higher today.", "Mice fear cats that chase."]
    assert salient(texts, [1, 1, 1, 1], 2) != [0, 1] and salient(texts, [1] * 4, 0) == []
    _, blocks = readers.read("markdown", RULES.encode())
    chunks = chunk_blocks(blocks, Options(min_chars=0))
    s = summarize(blocks, chunks)
    assert [o[0] for o in s.outline] == ["Parking", "Quiet hours"] and s.key_points
    assert plain.overview_chunks(chunks, [1], 2) == [0, 1]
