"""Near-duplicate texts by one-permutation MinHash, banded buckets and star-shaped candidates.

Each text becomes the set of its five-word shingles, as 64-bit hashes. Texts
with equal sets form one class. One hash per shingle fills the slots of a
signature: the high bits choose the slot, the smallest hash stays; an empty slot
borrows from the filled slot that comes first in its own fixed random order
(optimal densification). Bands of slots are the keys of buckets.

In each bucket the smallest class is the hub, and candidates are the pairs of the hub with the
others, so there are never more than classes times bands. Candidates that the
signatures do not rule out are confirmed on the full sets, and components follow
from the confirmed links. A star leaves pairs untested of which neither is the hub; these
matter only where a bucket still holds several components. There, and only
there, signatures are compared block by block, pairs of different components that
these don't rule out are confirmed too, and links that join components are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, tidy
from .components import components

WORDS = 5
#: 42 bands of 6 slots: a pair with similarity 0.80 shares no band once in 350,000 times, one with 0.85 once in 4e8.
BANDS, DEPTH = 42, 6
SLOTS = BANDS * DEPTH
#: Share of equal slots below which a pair of similarity 0.80 is ruled out: 6 standard errors below it.
LEAST_EQUAL = 0.65
#: Words hashed at a time, classes compared at a time, and bits of the bitmap of needed texts.
RUN_WORDS, BLOCK_CLASSES, FILTER_BITS = 50_000, 500, 1 << 23

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each number over all 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size == 1 << 16:  # of very long runs they are made each time
            _powers[base] = known
    return known[:n]


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of WORDS words; of all words if there are fewer; none without words.

    A run's hash is that of its words joined by one space, as a polynomial in
    its bytes: differences of running sums, brought to the same place."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = []
    for start in range(0, max(1, len(words) - WORDS + 1), RUN_WORDS):
        some = words[start : start + RUN_WORDS + WORDS - 1]
        data = np.frombuffer(b" ".join(some), np.uint8)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
        spaces = np.flatnonzero(data == 32)
        begin, end = np.append(0, spaces + 1), np.append(spaces, len(data))
        n = max(1, len(some) - WORDS + 1)
        begin, end = begin[:n], end[-n:]
        found.append(mixed((sums[end] - sums[begin]) * powers(BASE_INVERSE, len(data))[begin]))
    return np.unique(np.concatenate(found))


EDGES = np.array([-(-(n << 64) // SLOTS) for n in range(SLOTS)], np.uint64)
ORDER = np.random.default_rng(7).permuted(np.tile(np.arange(SLOTS, dtype=np.int16), (SLOTS, 1)), axis=1)
COEFFICIENTS = mixed(np.arange(1, DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
BAND_SEEDS = mixed(np.arange(1_000, 1_000 + BANDS, dtype=np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One value for each slot; hashes must be sorted and not empty."""
    first = np.searchsorted(hashes, EDGES)
    filled = first < np.append(first[1:], len(hashes))
    values = hashes[np.minimum(first, len(hashes) - 1)]
    if not filled.all():
        have = np.flatnonzero(filled)
        empty = np.flatnonzero(~filled)
        values[empty] = values[have[ORDER[empty][:, have].argmin(axis=1)]]
    return values


def _signed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the text, with size, digest of the set, slots and bands."""
    for part in (whole.slice(at, 500) for whole in parts for at in range(0, whole.num_rows, 500)):
        sizes, keys, slots, bands = [], [], [], []
        for text in part.column("text").cast(pa.binary()).to_pylist():
            hashes = shingles(text)
            sizes.append(len(hashes))
            if not len(hashes):
                keys.append(None)
                slots.append(None)
                bands.append(None)
                continue
            values = signature(hashes)
            keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            slots.append(mixed(values).astype(np.uint8).tobytes())
            bands.append(mixed((values.reshape(BANDS, DEPTH) * COEFFICIENTS).sum(axis=1, dtype=np.uint64) ^ BAND_SEEDS).view(np.int64))
        passed = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in passed), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(slots, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=[*passed, "n_shingles", "set_key", "slots", "bands"],
        )


def not_ruled_out(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity."""
    slim = classes.select("rep", "n_shingles", "slots")
    both = pairs.join(slim.toDF("a", "n_a", "slots_a"), "a").join(slim.toDF("b", "n_b", "slots_b"), "b")
    return both.where("100 * least(n_a, n_b) >= %d * greatest(n_a, n_b)" % percent).select("a", "b", "slots_a", "slots_b").mapInArrow(tidy(_alike), "a long, b long")


def _alike(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("slots_a", "slots_b"))
        yes = (a == b).sum(axis=1) >= LEAST_EQUAL * SLOTS
        yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(yes)) for c in ("a", "b")], names=["a", "b"])


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and hashes (sorted, 8 bytes each) of the full sets of the texts named by ids (id), and maybe of some more.

    Which texts are needed goes to the scan as a bitmap of FILTER_BITS hashed ids: 1 MB, whatever their
    number. It may let more texts through, few as long as the ids are few beside its bits; of
    more ids, the texts that it lets through meet the ids themselves before their sets are made."""
    ids = ids.distinct()
    hashed = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(hashed.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits")).collect()
    filter_ = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words:
        filter_[row["word"]] = row["bits"]
    crowded = np.bitwise_count(filter_).sum() > FILTER_BITS // 8
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            h = part.column("h").to_numpy()
            need = np.flatnonzero((shared.value[h >> 6] >> (h & 63)) & 1)
            for at in range(0, len(need), 256):
                some = part.take(pa.array(need[at : at + 256]))
                hashes = [shingles(t).tobytes() for t in some.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(hashes, pa.binary())], names=["id", "hashes"])

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    if crowded:
        known = known.join(ids, "id", "left_semi")
    known = known.select("id", hashed.alias("h"), "text")
    return staged(known.mapInArrow(tidy(sets), "id long, hashes binary").dropDuplicates(["id"]))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the full sets confirm: 100 * intersection >= percent * union."""
    full = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)
    both = pairs.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")

    def hold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = zip(part.column("set_a"), part.column("set_b"))
            yes = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in sets]
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(yes, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(tidy(hold), "a long, b long")


class Group:
    """Members of one bucket, or of two blocks of a large one, and the pairs of them that may be links across components."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        self.rep, self.component, self.size, self.own = (table[c].to_numpy() for c in ("rep", "component", "n_shingles", "own"))
        self.slots = np.frombuffer(b"".join(table["slots"].to_pylist()), np.uint8).reshape(-1, SLOTS)
        self.bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.band, self.percent = table["band"][0].as_py(), percent
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        self.left, self.right = np.flatnonzero(self.own == i), None if i == j else np.flatnonzero(self.own == j)

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member with the others that it may be linked to; a pair that shares several bands belongs to the first of these."""
        for n, x in enumerate(self.left):
            y = self.left[n + 1 :] if self.right is None else self.right
            y = y[(self.component[y] != self.component[x]) & (100 * np.minimum(self.size[y], self.size[x]) >= self.percent * np.maximum(self.size[y], self.size[x]))]
            y = y[(self.slots[y] == self.slots[x]).sum(axis=1) >= LEAST_EQUAL * SLOTS]
            first = (self.bands[y] == self.bands[x]).argmax(axis=1)
            y = y[self.bands[x][first] == self.band]
            if len(y):
                yield x, y


def across_components(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a bucket, but are in different components; enough to join these.

    members: band, rep, hub, component. Of each bucket with several components, all but the hub, whose pairs
    are known, are compared, by signature first. A bucket larger than BLOCK_CLASSES is dealt into
    blocks, and each pair of blocks is one group. Members that a signature may link to another
    component meet again with their full sets; a pair is confirmed there unless
    the links found before it in the group have joined its components already, so a group
    returns fewer links than it has members."""
    sizes = members.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
    split = members.where("rep <> hub").join(sizes.where("n > 2 AND x <> y").select("band", "n"), "band")
    blocks = F.ceil(F.col("n") / BLOCK_CLASSES).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = split.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = ["band", "i", "j"]
    fields = [*key, "own", "rep", "component", "n_shingles", "slots", "bands"]
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).join(classes.select("rep", "n_shingles", "slots", "bands"), "rep").select(*fields)

    def hopeful(table: pa.Table) -> pa.Table:
        some = set()
        for x, y in Group(table, percent).candidates():
            some.update([x, *y])
        return table.take(pa.array(sorted(some), pa.int64()))

    def join(table: pa.Table) -> pa.Table:
        group = Group(table, percent)
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["hashes"]]
        root = {c: c for c in group.component.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for x, others in group.candidates():
            for y in others[np.argsort(-(group.slots[others] == group.slots[x]).sum(axis=1), kind="stable")]:
                a, b = top(int(group.component[x])), top(int(group.component[y]))
                if a != b and similar(sets[x], sets[y], percent):
                    root[a] = b
                    links.append((int(group.rep[x]), int(group.rep[y])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    types = dict(dealt.dtypes)
    left = staged(dealt.groupBy(*key).applyInArrow(hopeful, ", ".join(f"{c} {types[c]}" for c in fields)))
    full = full_sets(left.select(F.col("rep").alias("id")), docs)
    return left.join(full.withColumnRenamed("id", "rep"), "rep").groupBy(*key).applyInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `also`, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Rows are linked when their sets of shingles have 100 * intersection >=
    percent * union; component_id is the smallest doc_id reachable by links, itself
    included, and kept says that it is the row's own. Texts that are null, empty or without words have an empty set
    and link with nothing. Rows with a null id link with nothing; their component is null, and they
    are kept. Rows that share an id are judged by their own texts, each with its own n_shingles; only
    where the id is the smallest of several of its texts' copies do these count as one document. An
    empty table gives an empty result; other columns are ignored. Bands and the
    cut of signatures are made for percent >= 80; less is refused."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100")
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also))
    types = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    signed = staged(docs.mapInArrow(tidy(_signed), f"{types}, n_shingles long, set_key binary, slots binary, bands array<long>"))
    told = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = told.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = staged(
        told.join(reps.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
        .dropDuplicates(["set_key", "doc_id"])
        .select("set_key", F.col("doc_id").alias("rep"), "n_shingles", "slots", "bands")
    )
    banded = classes.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last")
    shared = staged(banded.join(hubs.select("band", "hub"), "band"))
    stars = shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = staged(confirmed(staged(not_ruled_out(stars, classes, percent)), docs, percent))
    roots = staged(components(links))
    members = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = staged(across_components(members, classes, docs, percent))
    if not more.isEmpty():
        # what the links join is there as stars, to which only those found later are added
        roots = components(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    by_class = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    # a class of many copies is one row on the right, so AQE can split its rows on the left
    joined = signed.select("doc_id", *also, "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", *also, "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) c USING (doc_id)
"""
