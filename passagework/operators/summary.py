"""Extractive summaries: salient sentences by TF-IDF centroid and marginal relevance, abstracts, outlines, overview passages."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace

from ..functions.constants import ABSTRACT_HEADING, BACK_MATTER_PATH, BACK_MATTER_SECTION, CONCLUSION_HEADING, CUE_PHRASES, INTRO_HEADING, SUMMARY_SECTIONS
from ..functions.plain import split_sentences, squash, tokenize
from ..sources.readers import Block
from .chunk import PATH_MARK, Chunk

LAMBDA, KEY_POINTS, ABSTRACT_CHARS, OUTLINE = 0.7, 5, 1_800, 60


def matches(pattern: str, text: str | None) -> bool:
    return bool(text) and re.search(pattern, text, re.I) is not None


def cosine(a: dict[str, float], b: dict[str, float]) -> float:
    norms = math.sqrt(sum(w * w for w in a.values())) * math.sqrt(sum(w * w for w in b.values()))
    return sum(w * b.get(t, 0.0) for t, w in a.items()) / norms if norms else 0.0


def salient(sentences: list[str], bonus: list[float], k: int, trade: float = LAMBDA) -> list[int]:
    """Places of up to k sentences near the centroid and far from each other, in order of the text.

    Each step takes the sentence with the most relevance less redundancy, the first on a tie."""
    counts = [Counter(tokenize(s)) for s in sentences]
    df = Counter(t for c in counts for t in c)
    vectors = [{t: n * math.log(1 + len(sentences) / df[t]) for t, n in c.items()} for c in counts]
    centroid: Counter = Counter()
    for v in vectors:
        centroid.update(v)
    relevance = [cosine(v, centroid) * b for v, b in zip(vectors, bonus)]
    left = [n for n, c in enumerate(counts) if c]
    nearest = dict.fromkeys(left, 0.0)
    chosen: list[int] = []
    while left and len(chosen) < k:
        best = max(left, key=lambda n: trade * relevance[n] - (1 - trade) * nearest[n])
        chosen.append(best)
        left.remove(best)
        for n in left:
            near = cosine(vectors[n], vectors[best])
            nearest[n] = near if len(chosen) == 1 else max(nearest[n], near)
    return sorted(chosen)


@dataclass(frozen=True)
class Summary:
    abstract: str | None
    key_points: list[tuple[str, int | None, int | None]]  # text, chunk, page
    outline: list[tuple[str, int, int | None, int | None]]  # heading, level, page, chunk


def holding_chunk(text: str, chunks: list[Chunk]) -> int | None:
    """The first chunk that holds the first 120 letters and digits of the text."""
    wanted = squash(text)[:120]
    return next((c.index for c in chunks if wanted in squash(c.content)), None)


def is_abstract(heading: str) -> bool:
    return re.fullmatch("abstract|summary", heading.strip(), re.I) is not None


def outlined(blocks: list[Block], chunks: list[Chunk]) -> tuple[Summary, list[tuple[str, float, int | None]]]:
    """The summary without key points, and the sentences that these are chosen from, with their bonus and page."""
    parts: list[str] = []
    seen = inside = False
    for b in blocks:
        if b.kind == "heading":
            inside = not seen and is_abstract(b.text)
            seen = seen or inside
        elif inside and b.kind == "paragraph":
            parts.append(b.text)
    abstract = "\n\n".join(parts)[:ABSTRACT_CHARS] or None
    outline = []
    for b in [b for b in blocks if b.kind == "heading" and (b.level or 2) <= 2][:OUTLINE]:
        at = next((c.index for c in chunks if b.text in (c.heading or "").split(PATH_MARK) or b.text in c.content), None)
        outline.append((b.text, b.level or 2, b.page, at))
    candidates = []
    section = ""
    for b in blocks:
        if b.kind == "heading":
            section = b.text
        if b.kind != "paragraph" or re.match(BACK_MATTER_SECTION, section.strip(), re.I) or (abstract and is_abstract(section)):
            continue
        for n, sentence in enumerate(split_sentences(b.text)):
            bare = re.sub(r"^\(?([ivx]{1,4}|\d{1,2}|[a-h])\)\s+", "", sentence, flags=re.I)
            if 8 <= len(bare.split()) <= 45 and not re.search(r"https?://|^\[\d+\]", bare):
                candidates.append((bare, (1.2 if matches(SUMMARY_SECTIONS, section) else 1) * (1.25 if matches(CUE_PHRASES, bare) else 1) * (1.05 if n == 0 else 1), b.page))
    return Summary(abstract, [], outline), candidates


def summarize(blocks: list[Block], chunks: list[Chunk], most: int = KEY_POINTS) -> Summary:
    """The summary of one document; of many, salience.salient() chooses the key points."""
    made, candidates = outlined(blocks, chunks)
    chosen = salient([t for t, _, _ in candidates], [b for _, b, _ in candidates], most)
    return replace(made, key_points=[(candidates[n][0], holding_chunk(candidates[n][0], chunks), candidates[n][2]) for n in chosen])
