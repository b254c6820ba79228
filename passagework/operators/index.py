"""An inverted index of passages on disk, and exact search in it for the first passages of many questions.

Passages lie in blocks of BLOCK. The index holds a row for each term and block, sorted by term and dealt by ranges of it:
the places of the passages that hold the term, how often each does, and the most occurrences and the least length per occurrence
among them, which bound what the term can add to any score in the block, whatever the tuning and however many passages come later. Beside
that, each block has a row with the keys and lengths of its passages and their hashed embeddings. Texts are tokenised once, when the index
is built; a search reads the rows of the questions' terms.

A task keeps one heap for each question and list over all blocks that it reads. A block in which
no question can reach its heap's last score is left out, so a task gives as many rows as questions times the lists' lengths at most."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import plain
from ..functions.vectors import BUCKETS, bucket_sums, embedded, unit
from ..sources.tables import small_batches, written

#: Passages of a block, questions that meet the index in one reading, and places to which scores are rounded.
BLOCK, QUESTIONS, PLACES = 128, 1_024, 6
LISTS = ("vector_score", "bm25", "coverage")
POSTINGS = {"n": "int", "most": "int", "least": "double", "places": "array<int>", "counts": "array<int>"}
#: A block's embeddings: hashed ones as sums by bucket, in halves, exactly; stored ones behind each other.
HASHED = {"starts": "array<int>", "buckets": "array<int>", "halves": "array<int>"}
DENSE = {"dense": "array<float>"}


@dataclass(frozen=True)
class Index:
    """postings: term, block and what POSTINGS names; blocks: block, keys, lengths, size, tokens, and the embeddings, HASHED or DENSE, if it holds them."""

    postings: DataFrame
    blocks: DataFrame

    @property
    def vectors(self) -> list[str]:
        return [c for c in (*HASHED, *DENSE) if c in self.blocks.columns]


def build(passages: DataFrame, key: str, text: Column, vectors: bool = True, embedding: Column | None = None, path: str | None = None) -> Index:
    """The index of passages under `path`, else in the shared folder. Passages with a null key are left out; null texts have no terms.

    embedding: a provider's vectors, which the index holds in place of hashed ones; they must be of one length."""
    stored = [] if embedding is None else [embedding.cast("array<float>").alias("embedding")]
    inner = passages.select(F.col(key).alias("key"), text.alias("text"), *stored).where("key IS NOT NULL")
    dense = bool(stored)
    more_fields = DENSE if dense else HASHED if vectors else {}
    key_type = inner.schema["key"].dataType
    fields = {"block": "long", "term": "string", **POSTINGS, "keys": f"array<{key_type.simpleString()}>", "lengths": "array<int>", **more_fields}
    types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}
    arrow = {f: pa.list_(to_arrow_type(key_type)) if f == "keys" else types[t] for f, t in fields.items()}

    def batch(rows: int, **columns: object) -> pa.RecordBatch:
        made = [columns[f] if isinstance(columns.get(f), pa.Array) else pa.array(columns[f], t) if f in columns else pa.nulls(rows, t) for f, t in arrow.items()]
        return pa.RecordBatch.from_arrays([m.cast(t) for m, t in zip(made, arrow.values())], names=list(arrow))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for some in (part.slice(at, BLOCK) for part in parts for at in range(0, part.num_rows, BLOCK)):
            tokens = [plain.tokenize(t or "") for t in some.column("text").to_pylist()]
            length = np.array([len(t) for t in tokens])
            more = {}
            if dense:
                column = some.column("embedding")
                if column.null_count or len(set(np.diff(column.offsets.to_numpy()))) > 1:
                    raise ValueError("passages have no embeddings, or such of unequal length")
                more = {"dense": [column.flatten().to_numpy()]}
            elif vectors:
                sums = bucket_sums(tokens)
                owner, bucket = np.nonzero(sums)
                more = {"starts": [np.searchsorted(owner, np.arange(len(tokens) + 1))], "buckets": [bucket], "halves": [np.rint(2 * sums[owner, bucket]).astype(int)]}
            yield batch(1, block=[block], n=[len(tokens)], keys=[some.column("key").to_pylist()], lengths=[length], **more)
            if length.any():
                yield batch(**_postings(tokens, length, block))
            block += 1

    made = written(small_batches(inner).mapInArrow(run, ", ".join(f"{f} {t}" for f, t in fields.items())))
    terms = made.where("term IS NOT NULL").select("term", "block", *POSTINGS)
    blocks = made.where("term IS NULL").select("block", F.col("n").alias("size"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"), "keys", "lengths", *more_fields)
    # a term that all blocks hold has many rows; ranges of term and block part them
    by_term = written(terms.repartitionByRange("term", "block").sortWithinPartitions("term", "block"), path and f"{path}/postings")
    return Index(by_term, written(blocks, f"{path}/blocks") if path else blocks)


def _postings(tokens: list[list[str]], length: np.ndarray, block: int) -> dict:
    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(t, len(number)) for some in tokens for t in some), np.int64, int(length.sum()))
    pair, count = np.unique(at * BLOCK + np.repeat(np.arange(len(tokens)), length), return_counts=True)
    term, place = pair // BLOCK, pair % BLOCK
    starts = np.searchsorted(term, np.arange(len(number) + 1)).astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(starts), pa.array(x.astype(np.int32)))
    return {
        "rows": len(number),
        "block": np.full(len(number), block),
        "term": list(number),
        "n": np.diff(starts),
        "most": np.maximum.reduceat(count, starts[:-1]),
        "least": np.minimum.reduceat(length[place] / count, starts[:-1]),
        "places": lists(place),
        "counts": lists(count),
    }


def read(spark, path: str) -> Index:  # noqa: ANN001
    """The index that build() wrote under the path."""
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/blocks"))


class Asked:
    """Questions as arrays: their terms, and their embeddings, hashed ones or what `embed` makes of the texts, brought to unit length."""

    def __init__(self, keys: list, texts: list[str | None], embed: Callable[[list[str]], np.ndarray] | None = None) -> None:
        tokens = [plain.tokenize(t or "") for t in texts]
        self.keys, self.terms = keys, [list(dict.fromkeys(t)) for t in tokens]
        self.number = {t: n for n, t in enumerate(dict.fromkeys(t for some in self.terms for t in some))}
        self.vectors = unit(np.asarray(embed([t or "" for t in texts]), float)) if embed and texts else embedded(tokens)
        holders = [[] for _ in self.number]
        for q, some in enumerate(self.terms):
            for t in some:
                holders[self.number[t]].append(q)
        self.starts = np.cumsum([0, *map(len, holders)])  # questions of each term, one after the other
        self.holders = np.array([q for some in holders for q in some], np.int64)

    def weigh(self, docs: int, words: int, frequency: dict[int, int], k1: float, b: float) -> None:
        """Weights of the terms, from the number of passages, of all their tokens, and of passages with each term's number."""
        self.k1, self.b, self.mean = k1, b, words / docs if words else 1.0
        df = [frequency.get(n, 0) for n in self.number.values()]
        self.idf = np.array([math.log(1 + (docs - n + 0.5) / (n + 0.5)) for n in df])
        self.total = np.array([sum(self.idf[self.number[t]] for t in some) for some in self.terms])

    def gain(self, at: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[at] * count * (self.k1 + 1) / (count + self.k1 * (1 - self.b + self.b * length / self.mean))

    def bounds(self, at: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """What no BM25 score of the block exceeds, by question; most and least as in the postings of the terms `at`."""
        top = self.idf[at] * (self.k1 + 1) / (1 + self.k1 * ((1 - self.b) / most + self.b * least / self.mean))
        each, question = self.meeting(at)
        return np.bincount(question, top[each], len(self.keys))

    def meeting(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers in `at` with each of the questions that hold its term."""
        many = self.starts[at + 1] - self.starts[at]
        each = np.repeat(np.arange(len(at)), many)
        return each, self.holders[np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.starts[at][each]]

    def scores(self, at: np.ndarray, count: np.ndarray, place: np.ndarray, length: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
        """(question, passage) of bm25 and coverage, from the occurrences of terms in a block's passages; zero for questions that aren't live."""
        each, question = self.meeting(at)
        kept = live[question]
        each, question = each[kept], question[kept]
        cell, shape = question * len(length) + place[each], (len(self.keys), len(length))
        sums = lambda w: np.bincount(cell, w[each], shape[0] * shape[1]).reshape(shape)
        total = self.total[:, None]
        return {"bm25": sums(self.gain(at, count, length[place])), "coverage": np.divide(sums(self.idf[at]), total, out=np.zeros(shape), where=total > 0)}


class Best:
    """For each question the first passages so far by one score, ties to the smaller key, with all their scores."""

    def __init__(self, questions: int, size: int) -> None:
        self.score, self.rest = np.full((questions, size), -np.inf), np.zeros((questions, size, len(LISTS)))
        self.key = np.empty((questions, size), object)

    def offer(self, score: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """Scores (question, passage), -inf for none; scores of all lists lie behind each other in the last axis."""
        size, least = self.score.shape[1], self.score[:, -1]
        if score.shape[1] > size:
            least = np.maximum(least, np.partition(score, -size, axis=1)[:, -size])
        owner, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        if not len(owner):
            return
        touched = np.unique(owner)
        old_owner, old_place = np.nonzero(self.score[touched] > -np.inf)
        old = (touched[old_owner], old_place)
        owners, values = np.concatenate([old[0], owner]), np.concatenate([self.score[old], score[owner, at]])
        names, rest = np.concatenate([self.key[old], keys[at]]), np.concatenate([self.rest[old], scores[owner, at]])
        turn = {k: n for n, k in enumerate(sorted(set(names.tolist())))}
        order = np.lexsort((np.array([turn[k] for k in names.tolist()]), -values, owners))
        owners = owners[order]
        place = np.arange(len(owners)) - np.searchsorted(owners, owners)
        order, owners, place = order[place < size], owners[place < size], place[place < size]
        self.score[owners, place], self.key[owners, place], self.rest[owners, place] = values[order], names[order], rest[order]


def search(index: Index, questions: DataFrame, question_key: str, question: Column, key: str, lists: dict[str, int], k1: float, b: float, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """question_key, key, vector_score, bm25, coverage of at least the first passages of each of the lists, each so many long.

    vector_score compares embeddings, those of the questions made by `embed` if the index holds stored ones, and is null unless it is among the lists; bm25 is over all passages of the index; coverage is the share of the
    question's idf, absent terms included, that the passage holds. Scores have PLACES places. The vector list holds passages of any score, the others
    only those that share a term. Questions are dealt into groups of about QUESTIONS, which is what is sent to every task; each group reads the index."""
    n = questions.count()
    groups = max(1, -(-n // QUESTIONS))
    asked = questions.select(F.col(question_key).alias("key"), question.alias("text"))
    made = None
    for group in range(groups):
        some = asked.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == group) if groups > 1 else asked
        rows = sorted(some.collect(), key=lambda r: (r["key"] is None, r["key"]))
        one = _searched(index, Asked([r["key"] for r in rows], [r["text"] for r in rows], embed), asked, lists, k1, b)
        made = one if made is None else made.unionByName(one)
    return made.withColumnsRenamed({"question": question_key, "key": key})


def _searched(index: Index, asked: Asked, questions: DataFrame, lists: dict[str, int], k1: float, b: float) -> DataFrame:
    spark = index.blocks.sparkSession
    terms = spark.createDataFrame(pa.table({"term": pa.array(asked.number, pa.string()), "no": pa.array(asked.number.values(), pa.int32())}))
    hits = index.postings.join(terms, "term")
    frequency = {r["no"]: r["n"] for r in hits.groupBy("no").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the questions
    sums = index.blocks.agg(F.sum("size").alias("passages"), F.sum("tokens").alias("tokens")).first()
    asked.weigh(sums["passages"] or 0, sums["tokens"] or 0, frequency, k1, b)
    shipped = spark.sparkContext.broadcast(asked)  # QUESTIONS of them
    near = "vector_score" in lists
    of_block = hits.groupBy("block").agg(F.collect_list(F.struct("no", "most", "least", "n", "places", "counts")).alias("hits"))  # terms of one block
    blocks = index.blocks.select("block", "keys", "lengths", *(index.vectors if near else ()))
    met = blocks.join(of_block, "block", "left" if near else "inner").drop("block")
    key_type = blocks.schema["keys"].dataType.elementType
    names = ["question", "key", *LISTS]
    kinds = [to_arrow_type(questions.schema["key"].dataType), to_arrow_type(key_type), *[pa.float64()] * len(LISTS)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        best = {name: Best(len(asked.keys), long) for name, long in lists.items()}
        for part in parts if asked.keys else ():
            for at in range(part.num_rows):
                offer(asked, best, {c: part.column(c)[at] for c in part.schema.names})
        found = {}
        for heap in best.values():
            for q, place in zip(*(x.tolist() for x in np.nonzero(heap.score > -np.inf))):
                found[(q, heap.key[q, place])] = heap.rest[q, place].tolist()
        columns = [[asked.keys[q] for q, _ in found], [k for _, k in found], *([None if c == "vector_score" and not near else r[n] for r in found.values()] for n, c in enumerate(LISTS))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return small_batches(met).mapInArrow(run, f"question {questions.schema['key'].dataType.simpleString()}, key {key_type.simpleString()}, " + ", ".join(f"{c} double" for c in LISTS))


def vectors_of(block: dict[str, pa.Scalar], n: int) -> np.ndarray:
    """The embeddings of a block's n passages, of unit length."""
    if "dense" in block:
        return unit(block["dense"].values.to_numpy().astype(float).reshape(n, -1))
    starts, buckets, halves = (block[c].values.to_numpy() for c in HASHED)
    sums = np.zeros((n, BUCKETS))
    sums[np.repeat(np.arange(n), np.diff(starts)), buckets] = halves / 2
    return unit(sums)


def offer(asked: Asked, best: dict[str, Best], block: dict[str, pa.Scalar]) -> bool:
    """One block's passages offered to the heaps; False if none of them could have been taken and they weren't scored."""
    length = np.array(block["lengths"].as_py(), float)
    shape = (len(asked.keys), len(length))
    found = {c: np.zeros(shape) for c in LISTS}
    hits, live = block["hits"].values, np.ones(len(asked.keys), bool)
    if hits is not None:
        at, size = hits.field("no").to_numpy(), hits.field("n").to_numpy()
        if list(best) == ["bm25"]:
            live = asked.bounds(at, hits.field("most").to_numpy(), hits.field("least").to_numpy()) + 10**-PLACES >= best["bm25"].score[:, -1]
        if not live.any():
            return False
        found |= asked.scores(np.repeat(at, size), hits.field("counts").flatten().to_numpy().astype(float), hits.field("places").flatten().to_numpy(), length, live)
    if "vector_score" in best:
        found["vector_score"] = np.clip(asked.vectors @ vectors_of(block, len(length)).T, -1, 1)
    scores = np.stack([np.round(found[c], PLACES) + 0.0 for c in LISTS], axis=-1)
    keys = np.empty(len(length), object)
    keys[:] = block["keys"].as_py()
    for name, heap in best.items():
        score = scores[:, :, LISTS.index(name)]
        heap.offer(score if name == "vector_score" else np.where(score > 0, score, -np.inf), keys, scores)
    return True
