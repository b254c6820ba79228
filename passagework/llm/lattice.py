"""LM scoring: marginal probability of a text over all segmentations into subwords.

The pieces are those of an existing byte-level vocabulary, with the space
before a word as part of it. Their unigram scores are estimated on the training
documents: every distinct word, weighted by how often it occurs, is segmented by the
vocabulary's own machine, and the pieces are counted. A word's probability is the
sum over all its segmentations, by the forward recursion in log space, for
batches of distinct words of equal length at once; a text's is the product over its words and an end.

Words are scored once each, not once for each place. Words that make up 1 /
COMMON of all tokens or more, of which there can be COMMON at most, are looked up where the
texts are read. All others meet their scores in a join by word, in which
no word has more rows than that share.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import once, shipped
from .common import doc_key, small_batches, staged

COMMON, LONGEST_COMMON = 100_000, 64
#: Distinct words held while counting, words in a batch of the recursion, and pseudo-count of a piece.
HELD_WORDS, BATCH_WORDS, PSEUDO = 300_000, 4_096, 0.5


def split_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased: bytes know only ASCII letters and spaces."""
    return (text or "").encode().lower().split()


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learned, other = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words = [*learned, *other]
        n = [*learned.values(), *other.values()]
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*learned.values(), *([0] * len(other))], pa.int64()), pa.array(n, pa.int64())], names=["word", "learned", "n"])
        learned.clear()
        other.clear()
        return batch

    for part in parts:
        for text, trains in zip(part.column("text").to_pylist(), part.column("trains").to_pylist()):
            (learned if trains else other).update(split_words(text))
            if len(learned) + len(other) > HELD_WORDS:
                yield flush()
    yield flush()


class Lattice:
    """Forward recursion over a vocabulary's trie, for many words at a time."""

    def __init__(self, coder, log_chance: np.ndarray) -> None:
        machine = coder.machine
        inner = {node: n for n, node in enumerate(np.flatnonzero(machine.grows))}
        self.child = np.full((len(inner), 256), -1, np.int32)  # of inner nodes: the next inner node
        self.piece = np.full((len(inner), 256), -1, np.int32)  # and the piece that the step completes
        for edge, to in machine.edges.items():
            at = inner[edge >> 8]
            self.child[at, edge & 255] = inner.get(to, -1)
            self.piece[at, edge & 255] = machine.token_at[to]
        self.log_chance = np.append(log_chance, -np.inf)  # piece -1

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of each word."""
        out = np.zeros(len(words))
        order = sorted(range(len(words)), key=lambda n: len(words[n]))
        at = 0
        while at < len(order):
            size = len(words[order[at]])
            most = max(1, min(BATCH_WORDS, (BATCH_WORDS * 64) // (size + 1)))
            same = []
            while at < len(order) and len(words[order[at]]) == size and len(same) < most:
                same.append(order[at])
                at += 1
            out[same] = self.equal(np.frombuffer(b"".join(words[n] for n in same), np.uint8).reshape(len(same), size))
        return out

    def equal(self, codes: np.ndarray) -> np.ndarray:
        n, size = codes.shape
        forward = np.full((size + 1, n), -np.inf)
        forward[0] = 0
        for start in range(size):
            live = np.arange(n)
            node = np.zeros(n, np.int32)
            base = forward[start]
            for end in range(start, size):
                byte = codes[live, end]
                gain = self.log_chance[self.piece[node, byte]]
                made = np.flatnonzero(gain > -np.inf)
                if len(made):
                    who = live[made]
                    forward[end + 1, who] = np.logaddexp(forward[end + 1, who], base[who] + gain[made])
                node = self.child[node, byte]
                on = node >= 0
                live, node = live[on], node[on]
                if not len(live):
                    break
        return forward[size]


def score_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Rows train unless the crc32 of their id is 0 modulo 10, then they are held
    out. Tokens are the words of the whole text and one end. base_score adds up log10((c + 0.1) / (N + 0.1
    (V + 1))), with a token's count c, all N and distinct V of the training
    tokens; score is the lattice's log10 probability. Null and empty texts have the end alone.
    A null id counts as the empty text for held_out. Repeated rows are scored
    each and train each; an empty table gives an empty result; other columns are
    ignored. Without training rows all pieces are equally likely."""
    spark = docs.sparkSession
    content = shipped(spark, path)
    trains = (doc_key(F.col("doc_id")) % 10 != 0).alias("trains")
    rows = small_batches(docs.select(F.col("doc_id"), "text", trains))
    counted = rows.select("text", "trains").mapInArrow(_counted, "word binary, learned long, n long")
    words = staged(counted.groupBy("word").agg(F.sum("learned").alias("learned"), F.sum("n").alias("n")))
    sums = words.agg(F.coalesce(F.sum("learned"), F.lit(0)).alias("learned"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("learned") > 0).alias("distinct")).first()
    ends = rows.agg(F.count_if("trains").alias("ends")).first()["ends"]
    tokens, distinct = sums["learned"] + ends, sums["distinct"] + (ends > 0)
    unit = tokens + 0.1 * (distinct + 1)

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = once("code", content.value, pattern).machine
        total = [0] * (1 + max(machine.bytes_of))
        for part in parts:
            for word, n in zip(part.column("word").to_pylist(), part.column("learned").to_pylist()):
                for piece in machine.encode(b" " + word):
                    total[piece] += n
        some = [piece for piece, n in enumerate(total) if n]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[p] for p in some], pa.int64())], names=["piece", "n"])

    found = words.where("learned > 0").select("word", "learned").mapInArrow(pieces, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row a piece
    seen = np.zeros(1 + max(once("code", content.value, pattern).machine.bytes_of), np.float64)
    for row in found:
        seen[row["piece"]] = row["n"]
    mass = seen.sum() + ends + PSEUDO * (len(seen) + 1)
    log_chance = np.log((seen + PSEUDO) / mass)
    end_base, end_score = math.log10((ends + 0.1) / unit), math.log10((ends + PSEUDO) / mass)
    model = spark.sparkContext.broadcast(log_chance)

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(once("code", content.value, pattern), model.value)
        for part in parts:
            learned = part.column("learned").to_numpy()
            score = lattice.score([b" " + w for w in part.column("word").to_pylist()]) / math.log(10)
            columns = [part.column("word"), part.column("n"), pa.array((learned > 0).astype(np.int64)), pa.array(np.log10((learned + 0.1) / unit)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "known", "base", "score"])

    by_word = staged(words.mapInArrow(scored, "word binary, n long, known long, base double, score double"))
    is_common = (F.col("n") * COMMON >= sums["n"]) & (F.length("word") <= LONGEST_COMMON)
    common = {bytes(r["word"]): (r["known"], r["base"], r["score"]) for r in by_word.where(is_common).toLocalIterator()}  # COMMON words at most
    lookup = spark.sparkContext.broadcast(common)

    def same(text: str | None) -> bytes:
        """Tells texts apart under one id."""
        return xxhash.xxh3_128_digest((text or "").encode())

    def whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a document: what its common words and its end give."""
        known_of = lookup.value
        for part in parts:
            out = []
            for text in part.column("text").to_pylist():
                words = split_words(text)
                known, base, score = int(ends > 0), end_base, end_score
                for word, n in Counter(words).items():
                    if (has := known_of.get(word)) is not None:
                        known += n * has[0]
                        base += n * has[1]
                        score += n * has[2]
                out.append((same(text), len(words) + 1, known, base, score))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([o[n] for o in out], t) for n, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())))],
                names=["doc_id", "twin", "n_tokens", "known", "base", "score"],
            )

    def rare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document and word that is not common."""
        known_of = lookup.value
        for part in parts:
            for at in range(0, part.num_rows, 1_000):
                some = part.slice(at, 1_000)
                words, counts, owners, twins = [], [], [], []
                for n, text in enumerate(some.column("text").to_pylist()):
                    left = [(w, c) for w, c in Counter(split_words(text)).items() if w not in known_of]
                    words += [w for w, _ in left]
                    counts += [c for _, c in left]
                    owners.append(np.full(len(left), n))
                    twins += [same(text)] * len(left)
                if words:
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id").take(pa.array(np.concatenate(owners))), pa.array(twins, pa.binary()), pa.array(words, pa.binary()), pa.array(counts, pa.int32())],
                        names=["doc_id", "twin", "word", "times"],
                    )

    id_type = dict(docs.dtypes)["doc_id"]
    one = rows.select("doc_id", "text").mapInArrow(whole, f"doc_id {id_type}, twin binary, n_tokens long, known long, base double, score double")
    pairs = rows.select("doc_id", "text").mapInArrow(rare, f"doc_id {id_type}, twin binary, word binary, times int")
    met = pairs.join(by_word.where(~is_common).select("word", "known", "base", "score"), "word")
    parts = met.select("doc_id", "twin", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("n_tokens"), *[(F.col("times") * F.col(c)).alias(c) for c in ("known", "base", "score")])
    both = one.withColumn("rows", F.lit(1).cast("long")).unionByName(parts)
    sums_ = both.groupBy("doc_id", "twin").agg(*[F.sum(c).alias(c) for c in ("rows", "n_tokens", "known", "base", "score")])
    # rows that repeat id and text have met in one group, which is dealt out to them again
    each = sums_.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select(
        "doc_id",
        (doc_key(F.col("doc_id")) % 10 == 0).alias("held_out"),
        (F.col("n_tokens") / F.col("rows")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
    )


def op6_lattice_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
