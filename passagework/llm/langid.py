"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the character n-grams, of one to
four letters, that occur in both, divided by the root of the product of their
numbers; n-grams are hashed into DIMS places. A bounded sample of labelled
rows is fitted: some of it are landmarks, whose kernel matrix gives Nystroem features, and
one-versus-rest ridge regression on these gives one score per language. Texts
are scored in batches by two matrix products, with the landmarks and with the weights.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, doc_key, tidy

DIMS_BITS, LONGEST_GRAM, BATCH = 15, 4, 128
DIMS = 1 << DIMS_BITS
#: Characters of a text that are looked at at once.
PIECE = 1 << 20
#: The documented bounds of the fitted sample: rows and landmarks of each language.
SAMPLE_ROWS, LANDMARKS, RIDGE = 200, 32, 1e-3
UNDETERMINED = "und"

_folded: list[np.ndarray] = []


def folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _folded:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for code in range(sys.maxunicode + 1):
            if (c := chr(code)).isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _folded.append(table)
    return _folded[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Places of the n-grams of a whole text, repeats included, PIECE characters at a time; nothing without a letter."""
    before = np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        codes = folded()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate([before, codes, [32] if at + PIECE >= len(text) else []]).astype(np.uint32)
        codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]  # runs of other characters are one space
        before = codes[1 - LONGEST_GRAM :]  # n-grams across the cut; those within it come twice, which presence doesn't mind
        if not (codes != 32).any():
            continue
        rolled = np.zeros(len(codes), np.uint32)
        for n in range(1, min(LONGEST_GRAM, len(codes)) + 1):
            rolled = rolled[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
            spread = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield (spread ^ (spread >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(32 - DIMS_BITS)


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Presence of n-grams by row, and whether the text has a letter."""
    out, has = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), bool)
    for row, text in enumerate(texts):
        for places in grams(text or ""):
            out[row, places] = 1
            has[row] = True
    return out, has


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits
    weights: np.ndarray  # landmarks and a constant x languages

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Presence in the landmarks divided by the root of their numbers of n-grams, and these roots."""
        if getattr(self, "_marks", None) is None:
            marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
            roots = np.sqrt(np.maximum(1, marks.sum(axis=1)))
            self._marks = marks / roots[:, None], roots
        return self._marks

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.marks()[0].T) / np.sqrt(np.maximum(1, rows.sum(axis=1, keepdims=True)))

    def scores(self, kernel: np.ndarray) -> np.ndarray:
        return kernel @ self.weights[:-1] + self.weights[-1]

    def share(self, kernel: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The largest share of n-grams in common with a landmark, of the smaller of both, beyond those that fall on the same places by chance."""
        own, roots = np.sqrt(np.maximum(1, rows.sum(axis=1, keepdims=True))), self.marks()[1]
        chance = (own * roots) ** 2 / DIMS
        return ((kernel * own * roots - chance) / np.maximum(1, np.minimum(own, roots) ** 2 - chance)).max(axis=1).clip(0, 1)


def fit(bits: np.ndarray, languages: list[str]) -> Model:
    """bits: packed presence by row, rows in a fixed order; languages: their labels."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages])
    marks = np.sort(np.concatenate([np.flatnonzero(label == n)[:LANDMARKS] for n in range(len(names))]))
    model = Model(names, bits[marks], np.zeros(0))
    blocks = (bits[at : at + 2 * BATCH] for at in range(0, len(bits), 2 * BATCH))
    kernel = np.concatenate([model.kernel(np.unpackbits(some, axis=1).astype(np.float32)) for some in blocks]).astype(np.float64)
    values, axes = np.linalg.eigh(kernel[marks] + 1e-6 * np.eye(len(marks)))
    root = axes / np.sqrt(np.maximum(values, 1e-6)) @ axes.T
    features = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    targets = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.bincount(label, minlength=len(names))
    balance = (1 / share[label])[:, None]  # each language weighs the same
    ridge = np.linalg.solve(features.T @ (features * balance) + RIDGE * np.eye(features.shape[1]), features.T @ (targets * balance))
    model.weights = np.vstack([root @ ridge[:-1], ridge[-1:]]).astype(np.float32)
    return model


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """Packed presence and language of up to `rows` training rows of each language, those with the smallest hashes of their ids."""
    training = docs.where((doc_key(F.col("doc_id")) % 3 != 1) & F.col("lang").isNotNull())
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = training.select("doc_id", "lang").where("doc_id IS NOT NULL").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    texts = training.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, BATCH):
                some = part.slice(at, BATCH)
                bits, has = presence(some.column("text").to_pylist())
                keep = pa.array(has)
                columns = [some.column("doc_id").filter(keep), some.column("lang").filter(keep), pa.array([b.tobytes() for b in np.packbits(bits.astype(bool), axis=1)[has]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "bits"])

    found = texts.mapInArrow(tidy(packed), f"doc_id {dict(docs.dtypes)['doc_id']}, lang string, bits binary").dropDuplicates(["doc_id", "lang"]).collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"]))
    bits = np.frombuffer(b"".join(r["bits"] for r in found), np.uint8).reshape(len(found), DIMS // 8)
    return bits, [r["lang"] for r in found]


def identify(docs: DataFrame, keep: Sequence[str] = ("doc_id",), names: Sequence[str] = ("held_out", "lang_pred", "score", "known")) -> DataFrame:
    """The kept columns, held_out, lang_pred, score and known (or other names for them) of every row of docs (doc_id, text, lang).

    The model learns from text and lang of rows whose crc32 of the id is not 1
    modulo 3 and whose lang is not null: SAMPLE_ROWS of each language. A
    prediction sees the whole text and nothing else. score is the winning language's regression value,
    brought from -1..1 to 0..1; known is the largest share of n-grams that the text has in common with a
    landmark, of those of the smaller of both, beyond chance. Texts that are null or have no letter are `und` with score and known 0, and so
    are all if there is nothing to learn from. A null id counts as the empty
    text for held_out. Repeated rows are predicted each; an empty table gives an
    empty result; other columns are ignored."""
    bits, languages = sample(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(fit(bits, languages) if languages else None)  # SAMPLE bounds its size

    def start():
        model: Model | None = shipped.value

        def of(texts: list[str | None]) -> list[tuple]:
            rows, has = presence(texts)
            if not model:
                return [(UNDETERMINED, 0.0, 0.0)] * len(rows)
            kernel = model.kernel(rows)
            scores = model.scores(kernel)
            won, known = scores.argmax(axis=1), model.share(kernel, rows)
            return [(model.languages[w], float(min(1.0, max(0.0, (s[w] + 1) / 2))), float(k)) if h else (UNDETERMINED, 0.0, 0.0) for w, s, k, h in zip(won, scores, known, has)]

        return of

    held = doc_key(docs["doc_id"]) % 3 == 1
    said = beside(docs, keep, "text", "lang string, score double, known double", start, BATCH, [held])
    return said.toDF(*keep, *names)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
