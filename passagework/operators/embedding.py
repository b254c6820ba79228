"""Passages with the vectors that a provider makes of them, in batches, and the name of its model beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contextual_text
from ..sources.tables import small_batches
from .providers import Provider, with_retry

#: Texts that a provider is given at once.
BATCH = 64


def in_context() -> Column:
    """What is embedded and searched of a passage: its title and heading, and its content."""
    return contextual_text(F.col("title"), F.col("heading"), F.col("content"))


def checked(provider: Provider, texts: list[str]) -> np.ndarray:
    """One finite vector for each text, in their order, all of one length, however often the provider has to be asked."""
    made = np.asarray(with_retry(lambda: provider.embed(texts)), np.float32)
    if made.ndim != 2 or len(made) != len(texts) or not made.shape[1] or not np.isfinite(made).all():
        raise ValueError(f"the provider gave an array of shape {made.shape} for {len(texts)} texts, or numbers that aren't finite")
    return made


def embedded_passages(passages: DataFrame, provider: Provider, text: Column | None = None) -> DataFrame:
    """passages with embedding (array of float) and embedding_model, where they had some in place of these.

    A task asks the provider for BATCH texts at a time; a batch that fails after all tries fails the task, which Spark starts again."""
    inner = passages.drop("embedding", "embedding_model").withColumn("__text", in_context() if text is None else text)
    names = [c for c in inner.columns if c != "__text"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (part.slice(at, BATCH) for part in parts for at in range(0, part.num_rows, BATCH)):
            made = checked(provider, [t or "" for t in some.column("__text").to_pylist()])
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), vectors], names=[*names, "embedding"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema if f.name != "__text")
    return small_batches(inner).mapInArrow(run, f"{types}, embedding array<float>").withColumn("embedding_model", F.lit(provider.embedding_model))
