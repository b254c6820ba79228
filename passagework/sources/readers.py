"""Readers in Python for formats with state from line to line: one document in, typed blocks out."""

from __future__ import annotations

import html as entities
import io
import re
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

from ..functions.constants import LIST_LINE, MARKDOWN_MARKS
from . import csvio
from .native import ATX, FENCE, ITEM, RULE_ROW, TABLE_ROW, UNDERLINE

LEAST_CHARS = 20


@dataclass(frozen=True)
class Block:
    kind: str  # heading, paragraph, table or caption
    text: str
    level: int | None = None
    page: int | None = None
    page_end: int | None = None


class ReadError(ValueError):
    """A document that can't be read; its text and code are for the document's error columns: 413 too large, 415 of no known kind, 422 unreadable or empty."""

    def __init__(self, text: str, code: int = 422) -> None:
        super().__init__(text)
        self.code = code


def from_utf8(data: bytes) -> str:
    return data.decode("utf-8", "replace").removeprefix("﻿")


def lines_of(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")


def strip_markdown(text: str) -> str:
    """Plain text of Markdown, as functions.text.strip_markdown."""
    for pattern, by in MARKDOWN_MARKS:
        text = re.sub(pattern, by.replace("$", "\\"), text)
    return text


def text_blocks(text: str) -> list[Block]:
    parts = [p.strip() for p in re.split(r"\n\s*\n", lines_of(text)) if p.strip()]
    out = []
    for n, part in enumerate(parts):
        first = part[0]
        if (
            "\n" not in part
            and len(part) <= 80
            and n < len(parts) - 1
            and part[-1] not in ".!?,;:"
            and (first.isupper() or first in "0123456789")
            and len(part.split()) <= 10
        ):
            out.append(Block("heading", part, 1 if part == part.upper() else 2))
            continue
        lines = [line.strip() for line in part.split("\n")]
        listed = len(lines) > 1 and all(re.match(LIST_LINE, line) for line in lines)
        out.append(Block("paragraph", ("\n" if listed else " ").join(lines)))
    return out


#: Kinds of lines of Markdown by their patterns, and the kinds that end a paragraph and a table.
LINES = {"atx": ATX, "table": TABLE_ROW, "blank": r"^\s*$", "item": ITEM}
ENDS = {"text": {"atx", "setext", "table", "blank", "item"}, "table": {"atx", "setext", "blank", "item", "plain"}}


def told_lines(lines: list[str]) -> list[tuple[int, str, str]]:
    """Number, line and kind of the lines that are no fence and no underline of a heading, as native.markdown_lines."""
    fenced, out = False, []
    for n, line in enumerate(lines):
        if re.match(FENCE, line):
            fenced = not fenced
            continue
        before = out[-1] if out else (n, "", "blank")
        under = re.match(UNDERLINE, line) is not None
        if under and before[0] == n - 1 and before[2] == "setext":
            continue
        kind = "fenced" if fenced else next((k for k, pattern in LINES.items() if re.match(pattern, line)), "plain")
        above = n + 1 < len(lines) and re.match(UNDERLINE, lines[n + 1])
        if above and not under and kind in ("table", "item", "plain") and before[2] not in ("plain", "fenced"):
            kind = "setext"
        out.append((n, line, kind))
    return out


def markdown_blocks(text: str) -> list[Block]:
    """One Markdown text's blocks, by the sessions of native.markdown_blocks, which takes a table of texts."""
    lines = lines_of(text).split("\n")
    placed: list[tuple[int, int, Block]] = []
    open_: dict[str, list[str]] = {"text": [], "table": []}

    def ended(of: str, n: int, head: bool) -> None:
        held, open_[of] = open_[of], []
        if of == "text":
            said = re.sub(r"\s*\n\s*", " ", strip_markdown("\n".join(held))).strip()
        else:
            cells = [[strip_markdown(c).strip() for c in re.sub(r"^\s*\||\|\s*$", "", row).split("|")] for row in held if not re.match(RULE_ROW, row)]
            said = "\n".join(csvio.table_lines(cells)) if cells else ""
        placed.append((n, int((of == "table") == head), Block("paragraph" if of == "text" else "table", said)))

    for n, line, kind in told_lines(lines):
        head = kind in ("atx", "setext")
        for of in [of for of, enders in ENDS.items() if kind in enders]:
            ended(of, n, head)
        if head:
            atx = re.match(ATX, line) if kind == "atx" else None
            level = len(atx[1]) if atx else 1 if lines[n + 1].strip().startswith("=") else 2
            placed.append((n, 2, Block("heading", strip_markdown(atx[2] if atx else line).strip(), level)))
        elif kind == "item":
            placed.append((n, 2, Block("paragraph", strip_markdown(line).strip())))
        elif kind != "blank":
            open_["table" if kind == "table" else "text"].append(line)
    for of in open_:
        ended(of, len(lines), True)
    return [b for *_, b in sorted(placed, key=lambda p: p[:2]) if b.text]


def fragment_text(fragment: str) -> str:
    """Text of an HTML fragment; entities are decoded once, unknown ones stay."""
    bare = re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br[^>]*>", " ", fragment))
    known = {"amp", "lt", "gt", "quot", "apos", "nbsp"}

    def char(m: re.Match) -> str:
        name = m[1]
        return entities.unescape(m[0]) if name[0] == "#" or name in known else m[0]

    return " ".join(re.sub(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);", char, bare).replace(" ", " ").split())


def html_blocks(html: str) -> list[Block]:
    out = []
    for tag, inner in re.findall(r"(?is)<(h[1-6]|p|li|table)\b[^>]*>(.*?)</\1>", html):
        tag = tag.lower()
        if tag == "table":
            rows = [[fragment_text(c) for c in re.findall(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", inner)]
            text = "\n".join(csvio.table_lines(rows))
            kind, level = "table", None
        else:
            text = fragment_text(inner)
            kind, level = ("heading", int(tag[1])) if tag[0] == "h" else ("paragraph", None)
            text = f"- {text}" if tag == "li" and text else text
        if text:
            out.append(Block(kind, text, level))
    return out


def csv_blocks(text: str) -> list[Block]:
    rows = csvio.parse(text)
    return [Block("table", "\n".join(csvio.table_lines(rows)))] if rows else []


def docx_blocks(data: bytes) -> list[Block]:
    """Headings, list items, paragraphs and tables of a Word file's main part."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as problem:
        raise ReadError(f"not a readable Word file: {problem}") from problem

    def text(of: ElementTree.Element) -> str:
        return " ".join("".join(t.text or "" if t.tag == f"{w}t" else " " for t in of.iter() if t.tag in (f"{w}t", f"{w}tab", f"{w}br")).split())

    out = []
    for part in body if body is not None else []:
        if part.tag == f"{w}tbl":
            rows = [[text(c) for c in r.findall(f"{w}tc")] for r in part.findall(f"{w}tr")]
            out.append(Block("table", "\n".join(csvio.table_lines(rows))))
        elif part.tag == f"{w}p" and (said := text(part)):
            style = part.find(f"{w}pPr/{w}pStyle")
            name = (style.get(f"{w}val") or "") if style is not None else ""
            level = re.fullmatch(r"(?i)heading\s?([1-6])", name)
            listed = part.find(f"{w}pPr/{w}numPr") is not None
            out.append(Block("heading", said, int(level[1])) if level else Block("heading", said, 1) if name.lower() == "title" else Block("paragraph", f"- {said}" if listed else said))
    return [b for b in out if b.text]


def with_title(blocks: list[Block]) -> tuple[str | None, list[Block]]:
    """The first block as title if it is the only heading of level 1 and more follows."""
    top = [b for b in blocks if b.kind == "heading" and b.level == 1]
    if len(blocks) > 1 and len(top) == 1 and blocks[0] is top[0]:
        return blocks[0].text, blocks[1:]
    return None, blocks


def read(kind: str | None, data: bytes) -> tuple[str | None, list[Block]]:
    """Title and blocks of a file; ReadError if it can't be read or holds next to no text."""
    if kind in ("markdown", "docx"):
        title, blocks = with_title(markdown_blocks(from_utf8(data)) if kind == "markdown" else docx_blocks(data))
    elif kind == "html":
        title, blocks = with_title(html_blocks(from_utf8(data)))
    elif kind in ("text", "csv"):
        title, blocks = None, (text_blocks if kind == "text" else csv_blocks)(from_utf8(data))
    elif kind == "pdf":
        raise ReadError("no glyph decoder for PDF is installed; give its text runs to layout.read_pages", 415)
    else:
        raise ReadError("unsupported file type", 415)
    blocks = [b for b in blocks if b.text.strip()]
    if sum(len(b.text.strip()) for b in blocks) < LEAST_CHARS:
        raise ReadError("the file holds almost no text")
    return title, blocks
