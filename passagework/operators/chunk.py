"""Cutting a document's blocks into passages that never break a sentence."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BACK_MATTER_HEADING
from ..functions.plain import split_sentences
from ..sources.readers import Block, text_blocks

LONGEST_OVERLAP, TINY = 320, 40
PATH_MARK = " › "


@dataclass(frozen=True)
class Options:
    max_chars: int = 1_200
    min_chars: int = 350
    overlap: int = 1

    def __post_init__(self) -> None:
        if self.max_chars < TINY or not 0 <= self.min_chars < self.max_chars or self.overlap < 0:
            raise ValueError("max_chars must be 40 or more, min_chars from 0 to below it, overlap not negative")


@dataclass(frozen=True)
class Piece:
    text: str
    joint: str  # what stands before it: a blank line, a line break, or a space
    path: str | None
    page: int | None = None
    page_end: int | None = None
    heading: bool = False


@dataclass(frozen=True)
class Chunk:
    index: int
    content: str
    heading: str | None
    page_start: int | None
    page_end: int | None


def rendered(pieces: list[Piece]) -> str:
    return "".join((p.joint if n else "") + p.text for n, p in enumerate(pieces))


def units(block: Block, most: int) -> list[str]:
    """Lines of a table or sentences of a text, those that are too long by words, and too long words by slices."""
    out = []
    for unit in [u.strip() for u in block.text.split("\n")] if block.kind == "table" else split_sentences(block.text):
        line = ""
        for word in unit.split(" ") if len(unit) > most else [unit]:
            slices = [word[n : n + most] for n in range(0, len(word), most)] or [""]
            for part in slices:
                if line and len(line) + 1 + len(part) > most:
                    out.append(line)
                    line = part
                else:
                    line = f"{line} {part}" if line else part
        out.append(line)
    return [u for u in out if u]


@dataclass
class Chunker:
    options: Options = field(default_factory=Options)
    chunks: list[Chunk] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    open: list[Piece] = field(default_factory=list)
    carried: int = 0

    def label(self) -> str | None:
        named = [p for p in self.path if p]
        return PATH_MARK.join(named[-2:]) or None

    def close(self, carry: bool) -> None:
        if not self.open:
            return
        weight: dict[str | None, int] = defaultdict(int)
        for p in self.open:
            weight[p.path] += len(p.text)
        pages = [n for p in self.open for n in (p.page, p.page_end) if n is not None]
        self.chunks.append(Chunk(len(self.chunks), rendered(self.open), max(weight, key=weight.__getitem__), min(pages, default=None), max(pages, default=None)))
        kept: list[Piece] = []
        for p in reversed(self.open if carry else []):
            if len(kept) == self.options.overlap or p.heading or len(p.text) > LONGEST_OVERLAP:
                break
            kept.insert(0, p)
        self.open = [replace(p, joint="\n\n") if n == 0 else p for n, p in enumerate(kept)]
        self.carried = len(kept)

    def heading(self, block: Block) -> None:
        level = min(6, max(1, block.level or 2))
        if len(self.open) == self.carried:
            self.open, self.carried = [], 0
        if len(rendered(self.open)) >= self.options.min_chars or (self.open and re.match(BACK_MATTER_HEADING, block.text, re.I)):
            self.close(carry=False)
        self.path = (self.path + [""] * level)[: level - 1] + [block.text]
        if self.open:
            self.open.append(Piece(block.text, "\n\n", self.label(), block.page, block.page_end, heading=True))

    def body(self, block: Block) -> None:
        for n, text in enumerate(units(block, self.options.max_chars)):
            joint = "\n\n" if n == 0 else "\n" if block.kind == "table" else " "
            if self.open and len(rendered(self.open)) + (2 if n == 0 else 1) + len(text) > self.options.max_chars:
                self.close(carry=True)
                if self.open and len(rendered(self.open)) + 2 + len(text) > self.options.max_chars:
                    self.open, self.carried = [], 0
            self.open.append(Piece(text, joint, self.label(), block.page, block.page_end))

    def run(self, blocks: list[Block]) -> list[Chunk]:
        for block in blocks:
            (self.heading if block.kind == "heading" else self.body)(block)
        if len(self.open) > self.carried:
            self.close(carry=False)
        return self.chunks


def chunk_blocks(blocks: list[Block], options: Options | None = None) -> list[Chunk]:
    return Chunker(options or Options()).run(blocks)


CHUNK_FIELDS = "chunk_index int, content string, heading string, page_start int, page_end int"


def chunks_of_texts(docs: DataFrame, key: str, text: str = "text", options: Options | None = None) -> DataFrame:
    """key and the passages of every plain text; one text is cut where it lies, without a shuffle."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 500):
                some = part.slice(at, 500)
                found = [chunk_blocks(text_blocks(t or ""), options) for t in some.column("text").to_pylist()]
                owner = [n for n, cs in enumerate(found) for _ in cs]
                flat = [c for cs in found for c in cs]
                columns = [pa.array([getattr(c, name) for c in flat], kind) for name, kind in (("index", pa.int32()), ("content", pa.string()), ("heading", pa.string()), ("page_start", pa.int32()), ("page_end", pa.int32()))]
                yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(owner, pa.int64())), *columns], names=["key", "chunk_index", "content", "heading", "page_start", "page_end"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {CHUNK_FIELDS}").withColumnRenamed("key", key)


def sentences_of_texts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, sentence of every text."""

    @F.pandas_udf("array<string>")
    def split(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: split_sentences(t or ""))

    return docs.select(F.col(key), F.posexplode(split(F.col(text))).alias("ord", "sentence"))
