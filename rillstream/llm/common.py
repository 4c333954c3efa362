"""Shared pieces of the training-data operators: tables, scratch space, text helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstream.plans.scratch import staged, unstage

__all__ = ["WORD", "free_name", "sliced", "staged", "table", "text_or_empty", "unstage", "usable_vector", "vectors"]

#: Java and Python regular expression for one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores before it until no column of df has that name (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls and of one length as a float32 or float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what Python makes of a batch stays small; what is freed goes
    back to the system after every batch that came."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers share an executor's memory, also while they wait for tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def usable_vector(col: str) -> Column:
    """True where the vector is not null, not all zero and has only finite components."""
    c = F.col(col)
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & good & F.exists(c, lambda x: x != 0), F.lit(False))
