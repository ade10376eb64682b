"""Shared pieces of the corpus operators: table access, lineage cuts, Arrow maps.

Words are always ``[^\\x20\\x09-\\x0D]+``: exactly what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, importable, shared_folder, spread, table

__all__ = ["WORD", "arrow_map", "content_key", "cut", "importable", "mix64", "pieces", "spread", "table", "tidy", "width", "written"]

WORD = r"[^\x20\x09-\x0D]+"


def width(spark: SparkSession) -> int:
    """Partitions that the session gives to a shuffle; the cluster sizes it to its data."""
    return max(1, int(importable(spark).conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def content_key(text: Column) -> list[Column]:
    """128 bits of SHA-256 of a text as two longs; null counts as empty."""
    h = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(h, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "k1"), (16, "k2"))]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map that gives its memory back when it ends: Python workers stay for later tasks, beside the executor's heap."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

    return tidied


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with state made once a task. ``make`` runs on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    importable(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def pieces(column: pa.Array, limit: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a text column as UTF-8 (null: empty), in runs of about ``limit`` bytes; one long text makes its own run."""
    out: list[bytes] = []
    first = size = 0
    for at in range(0, len(column), 256):
        for i, value in enumerate(column.slice(at, 256).cast(pa.large_binary()).to_pylist(), at):
            value = value or b""
            if out and size + len(value) > limit:
                yield first, out
                out, first, size = [], i, 0
            out.append(value)
            size += len(value)
    if out:
        yield first, out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
