"""What the operators of this subpackage share: tables, staging and ASCII helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One word of the contracts: a run of anything but space and the five ASCII controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the cluster names none and Spark runs in one process, as in tests, a
    temporary folder is taken and set; otherwise that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and context.getCheckpointDir():
        found = context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = tempfile.mkdtemp(prefix="spark-staged-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back.

    This cuts the lineage, survives the loss of an executor, and lets later
    steps read only the columns that they need."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    small_batches(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def doc_key(doc_id: Column) -> Column:
    """crc32 of the id as text, by which the contracts hold documents out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

#: Bytes of a batch that goes to a Python worker at once; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold BATCH_BYTES at most, so that workers don't hold thousands of long texts at once."""
    conf = df.sparkSession.conf
    set_ = conf.get(BYTES_SETTING).rstrip("bB")
    if not set_.isdigit() or int(set_) > BATCH_BYTES:
        conf.set(BYTES_SETTING, BATCH_BYTES)
    return df


Batches = Iterator[pa.RecordBatch]


#: What a worker keeps from task to task, by the module that made it.
KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Gives memory that this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def drop_kept(owner: str) -> None:
    """Drops what this process kept for other modules than the owner, and gives its memory back.

    It is a function of the module, so that it reaches a worker by name: a function within another one goes there with copies of
    the globals that it names, and KEPT would be an empty copy."""
    others = KEPT.keys() - {owner}
    for other in others:
        del KEPT[other]
    if others:
        give_back()


def tidy(run: Callable[[Batches], Batches], owner: str | None = None) -> Callable[[Batches], Batches]:
    """run, which first drops what the worker kept from tasks of other modules, and at its end gives memory that it no longer uses back to the system.

    Spark keeps workers for the next task, whatever that is, and several of them wait beside those that work."""
    owner = owner or run.__module__

    def tidied(parts: Batches) -> Batches:
        drop_kept(owner)
        try:
            yield from run(parts)
        finally:
            give_back()

    return tidied


def beside(docs: DataFrame, keep: Sequence[str], texts: str | Column, made: str, start: Callable[[], Callable[[list], list[tuple]]], rows: int = 1_000, extra: Sequence[Column] = ()) -> DataFrame:
    """The kept columns of docs, the extra ones, and what a function makes of the texts, a column's name or an expression.

    start() gives that function in each task; it takes some values of `texts`
    and returns a tuple for each, with the fields of the schema `made`. Columns go
    through Arrow under names of their own, so no name of docs can clash; a kept column
    that is also the texts goes through once."""
    fields = [f.strip().split(" ", 1) for f in made.split(", ")]
    names = [f"k{n}" for n in range(len(keep))]
    inner = [docs[c].alias(n) for c, n in zip(keep, names)] + [c.alias(f"x{n}") for n, c in enumerate(extra)]
    of = names[list(keep).index(texts)] if isinstance(texts, str) and texts in keep else "t"
    if of == "t":
        inner.append((docs[texts] if isinstance(texts, str) else texts).alias("t"))
    inner = small_batches(docs.select(*inner))
    passed = [f for f in inner.schema if f.name != "t"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_of = start()
        for part in parts:
            for at in range(0, part.num_rows, rows):
                some = part.slice(at, rows)
                out = made_of(some.column(of).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in passed), *(pa.array([o[n] for o in out], ARROW[kind]) for n, (_, kind) in enumerate(fields))], names=[*(f.name for f in passed), *(f"m{n}" for n in range(len(fields)))])

    types = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in passed), *(f"m{n} {kind}" for n, (_, kind) in enumerate(fields))])
    return inner.mapInArrow(tidy(run, start.__module__), types).toDF(*keep, *(f"extra{n}" for n in range(len(extra))), *(name for name, _ in fields))
