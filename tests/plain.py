"""Plain versions, one document or question at a time, that tests hold the row-wise operators against."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from passagework.functions.constants import ABSTRACT_HEADING, BACK_MATTER_PATH, CONCLUSION_HEADING, INTRO_HEADING, TABLE_LINE
from passagework.functions.plain import normalize_for_match
from passagework.operators.answer import Source
from passagework.operators.chunk import Chunk
from passagework.operators.summary import matches


def mostly_table(content: str) -> bool:
    lines = [line for line in content.split("\n") if line.strip()]
    return bool(lines) and 2 * sum(bool(re.search(TABLE_LINE, line)) for line in lines) > len(lines)


def overview_chunks(chunks: list[Chunk], points: list[int | None], limit: int) -> list[int]:
    """Up to `limit` chunks that give the gist: abstract or opening, introduction, last conclusion, key points, then prose at even distances."""
    body = {c.index: c for c in chunks if not matches(BACK_MATTER_PATH, c.heading)}
    if limit <= 0 or not body:
        return []
    headed = lambda pattern: [n for n, c in body.items() if matches(pattern, c.heading)]
    wanted = [*(headed(ABSTRACT_HEADING)[:2] or [next(iter(body))]), *headed(INTRO_HEADING)[:1], *headed(CONCLUSION_HEADING)[-1:], *points]
    picked = list(dict.fromkeys(n for n in wanted if n in body))[:limit]
    prose = [n for n, c in body.items() if n not in picked and not mostly_table(c.content)]
    if (room := limit - len(picked)) and prose:
        step = len(prose) / (room + 1)
        places = (min(len(prose) - 1, math.floor(step * n + 0.5)) for n in range(1, room + 1))
        picked += list(dict.fromkeys(prose[p] for p in places))
    return sorted(picked)


@dataclass(frozen=True)
class Citation:
    order: int
    source: int
    document: str
    chunk_index: int
    quote: str
    verified: bool


def resolve(raw: list[tuple[object, str]], sources: list[Source]) -> list[Citation]:
    """Citations of sources that exist, each quote of a source once, checked against its passage."""
    by_index = {s.index: s for s in sources}
    out: dict[tuple[int, str], Citation] = {}
    for number, quote in raw:
        if isinstance(number, bool) or not isinstance(number, (int, float)) or number != int(number) or int(number) not in by_index:
            continue
        source, quote = by_index[int(number)], quote.strip()
        plain = normalize_for_match(quote)
        verified = len(plain) >= 3 and plain in normalize_for_match(source.content)
        out.setdefault((source.index, plain), Citation(len(out), source.index, source.document, source.chunk_index, quote, verified))
    return list(out.values())
