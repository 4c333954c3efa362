"""Byte limits along an ordered stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstream.functions.names import free_names
from rillstream.operators.order import _in_order, added, comparable
from rillstream.operators.ranks import with_sum_before
from rillstream.plans.scratch import staged


def prefix_max_bytes(df: DataFrame, size_col: str, position: str, limit: int) -> DataFrame:
    """The rows a writer takes that closes once `limit` bytes are written: those before which less than that was written."""
    before = free_names(df.columns, "__before")[0]
    return with_sum_before(df, [F.col(position)], F.coalesce(F.col(size_col), F.lit(0)), before).where(F.col(before) < limit).drop(before)


class Roller:
    """Follows sizes and tells where files start: a file ends after the row that makes it exceed the limit."""

    def __init__(self, limit: int):
        self.limit, self.written = limit, 0

    def starts(self, sizes: np.ndarray) -> np.ndarray:
        """Rows after which a new file starts; one search for each file, not a step for each row."""
        total = np.cumsum(sizes)
        ends, before = [], -self.written
        while self.limit > 0 and len(total):
            k = int(np.searchsorted(total, before + self.limit, side="right"))
            if k == len(total):
                break
            ends.append(k)
            before = int(total[k])
        self.written = int(total[-1]) - before if len(total) else self.written
        return np.array(ends, np.int64)


def roll_by_size(df: DataFrame, size_col: str, position: str, limit: int, within: Sequence[str] = (), name: str = "file_idx") -> DataFrame:
    """Numbers files: a file ends after the row that makes it exceed `limit` bytes; no limit if it is 0 or less.

    Where a file starts depends on all sizes before. Of one order, positions and sizes (and nothing else) go through one
    task, which sorts them (it spills) and searches them in bulk; what comes out is a row for each file. The rows
    themselves are numbered where they are, by a running count of starts over range partitions. Positions must be unique.

    `within` numbers the files of each group on its own, in one shuffle by group.
    """
    if within:
        return _roll_within(df, size_col, position, limit, list(within), name)
    if limit <= 0:
        return df.withColumn(name, F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, fresh = Roller(limit), False
        for batch in batches:
            ends = roller.starts(batch[1].to_numpy(zero_copy_only=False).astype(np.int64)) + 1
            at = np.concatenate([[0], ends]) if fresh else ends
            fresh = len(ends) > 0 and ends[-1] == len(batch) or (fresh and not len(batch))
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(at[at < len(batch)]))], names=[opens])

    opens, new, seen = free_names([*df.columns, name], "__opens", "__new", "__seen")
    added(df, name, T.LongType())
    kind = T.StructType([T.StructField(opens, df.schema[position].dataType)])
    slim = df.select(F.col(position), F.coalesce(F.col(size_col).cast("long"), F.lit(0)))
    starts = staged(slim.repartition(1).sortWithinPartitions(position).mapInArrow(run, kind), "file-starts")
    marked = df.join(starts, F.col(position) == F.col(opens), "left").withColumn(new, F.col(opens).isNotNull().cast("long"))
    counted = with_sum_before(marked, [F.col(position)], F.col(new), seen)
    return counted.select(*df.columns, (F.col(seen) + F.col(new)).cast("long").alias(name))


def _roll_within(df: DataFrame, size_col: str, position: str, limit: int, parts: list[str], name: str) -> DataFrame:
    kind = added(df, name, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, roller, index = None, Roller(limit), 0
        for batch in batches:
            keys = comparable(batch, parts)
            sizes = batch.column(batch.schema.get_field_index(size_col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            out = np.empty(len(keys), np.int64)
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if keys[a] != now:
                    now, roller, index = keys[a], Roller(limit), 0
                new = np.zeros(b - a + 1, np.int64)
                new[roller.starts(sizes[a:b]) + 1] = 1
                numbers = index + np.cumsum(new)
                out[a:b], index = numbers[:-1], int(numbers[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return _in_order(df, parts, position).mapInArrow(run, kind)
