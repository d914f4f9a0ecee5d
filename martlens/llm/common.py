"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable
from pathlib import PurePath

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from martlens.functions.lineage import cut as stash
from martlens.functions.lineage import shared_folder

__all__ = ["CHUNK_BYTES", "WORD", "chunks", "mix64", "release", "schema_of", "shared_folder", "ship", "stash", "table", "texts_of", "unit"]

#: Words are maximal runs of code points other than space and \x09-\x0D, which is also how bytes.split() cuts.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that are worked on together; bounds a kernel's arrays whatever the length of the batch.
CHUNK_BYTES = 1 << 20


def release() -> None:
    """At a task's end: hand the memory that this worker no longer uses back, as the next task may be another stage's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such function
            ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession, path: str) -> Callable[[], str]:
    """Send a file of the driver's to all executors; in a task, the result gives its path there."""
    spark.sparkContext.addFile(path)
    name = PurePath(path).name
    return lambda: SparkFiles.get(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts hold about `limit` bytes, one row at least."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def schema_of(df: DataFrame, keep: list[str], more: str) -> StructType:
    """The kept columns of df, then those that a DDL string names."""
    return StructType([*(StructField(c, df.schema[c].dataType) for c in keep), *StructType.fromDDL(more)])
