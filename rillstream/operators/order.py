"""Operators on ordered record streams. Row order is data: every operator takes it as columns.

A stream is a DataFrame with a position column; several streams are told apart by STREAM, their number.

Where Python is needed it gets Arrow batches and reads the partition values and keys only; rows pass through untouched.
A null key comes before all others and NaN after them, and each equals itself; a null partition value is one of its own.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstream.functions.names import free_names
from rillstream.operators.ranks import with_previous, with_rank

STREAM = "stream_idx"


def concat(streams: Sequence[DataFrame], stream_col: str = STREAM) -> DataFrame:
    """All rows, with the number of their stream: streams follow each other in the order given."""
    out = None
    for k, df in enumerate(streams):
        one = df.withColumn(stream_col, F.lit(k))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no streams")
    return out


def merge_order(keys: list[str], position: str, stream_col: str = STREAM) -> list[Column]:
    """The order of a k-way merge: among equal keys the later stream comes first, then the position."""
    return [*[F.col(k).asc() for k in keys], F.col(stream_col).desc(), F.col(position).asc()]


def kway_merge(streams: Sequence[DataFrame], keys: list[str], position: str) -> DataFrame:
    """Merges streams that are sorted by keys. The result is in order; use merge_ranked to carry the order as a column."""
    return concat(streams).orderBy(*merge_order(keys, position))


def merge_ranked(streams: Sequence[DataFrame], keys: list[str], position: str, name: str = "rank") -> DataFrame:
    return with_rank(concat(streams), merge_order(keys, position), name)


def dedup_adjacent(df: DataFrame, keys: list[str], position: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Drops rows whose keys equal those of the row before; keys with nulls equal nothing. The first of a run stays."""
    before = free_names(df.columns, *[f"__p_{k}" for k in keys])
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(position)
        prev = df.withColumns({p: F.lag(k).over(w) for k, p in zip(keys, before, strict=True)})
    else:
        prev = with_previous(df, [F.col(position)], {p: F.col(k) for k, p in zip(keys, before, strict=True)})
    same = F.lit(True)
    for k, p in zip(keys, before, strict=True):
        same = same & F.coalesce(F.col(k) == F.col(p), F.lit(False))
    return prev.where(~same).select(*df.columns)


def sort_last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """A sort buffer that holds all rows: sorted by keys, of equal keys only the last that came.

    One shuffle by key with map-side aggregation, so a hot key costs one row for each task; then the sort.
    """
    rest = [c for c in df.columns if c not in keys]
    row = free_names(df.columns, "__row")[0]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias(row))
    return last.select(*[F.col(k) if k in keys else F.col(f"{row}.{k}").alias(k) for k in df.columns]).orderBy(*keys)


def bounded_sort(df: DataFrame, keys: list[str], position: str, lookahead: int, partition_by: Sequence[str], name: str = "emitted") -> DataFrame:
    """A sort buffer of `lookahead` rows for each partition value: a full buffer lets its smallest key go.

    A row whose key is still in the buffer replaces the older one. Rows pass through in position order, so a task holds
    no more than the buffer. `name` numbers the emitted rows of each partition value from 0.
    """
    if lookahead < 1:
        raise ValueError("lookahead must be at least 1")
    return _buffered(df, keys, position, partition_by, name, lambda: Buffer(lookahead))


def cascaded_sort(df: DataFrame, keys: list[str], position: str, size: int, partition_by: Sequence[str], name: str = "emitted") -> DataFrame:
    """Sort buffers of `size` rows behind each other, up to BUCKETS for each partition value: a row that comes too late
    for a full buffer - its key is below all that are in it - goes on to the next one; the last takes any row. So rows
    that are late once and again do not break the order of those before them. `name` numbers the emitted rows."""
    if size < 1:
        raise ValueError("size must be at least 1")
    return _buffered(df, keys, position, partition_by, name, lambda: Cascade(size))


#: Buffers of a cascade (fixed value: it decides which rows leave when).
BUCKETS = 7


class Buffer:
    """Rows by key; a full buffer lets its smallest key go, of equal keys the later row stays. Rows are numbers."""

    def __init__(self, size: int):
        self.size, self.heap, self.held = size, [], {}

    def pop(self) -> int:
        return self.held.pop(heapq.heappop(self.heap))

    def put(self, key: tuple, row: int) -> Iterator[int]:
        if key not in self.held:
            if len(self.heap) >= self.size:
                yield self.pop()
            heapq.heappush(self.heap, key)
        self.held[key] = row

    def flush(self) -> Iterator[int]:
        while self.heap:
            yield self.pop()

    def rows(self) -> list[int]:
        return list(self.held.values())

    def renumber(self, new: dict[int, int]) -> None:
        self.held = {k: new[r] for k, r in self.held.items()}


class Cascade:
    def __init__(self, size: int):
        self.size, self.buffers = size, []

    def put(self, key: tuple, row: int) -> Iterator[int]:
        for k, b in enumerate(self.buffers):
            filling = len(b.heap) < self.size
            if filling or key >= b.heap[0] or k == BUCKETS - 1:
                if key not in b.held:
                    heapq.heappush(b.heap, key)
                b.held[key] = row
                if not filling:
                    yield b.pop()
                return
        self.buffers.append(Buffer(self.size))
        yield from self.buffers[-1].put(key, row)

    def flush(self) -> Iterator[int]:
        for b in self.buffers:
            yield from b.flush()
        self.buffers = []

    def rows(self) -> list[int]:
        return [r for b in self.buffers for r in b.rows()]

    def renumber(self, new: dict[int, int]) -> None:
        for b in self.buffers:
            b.renumber(new)


def _buffered(df: DataFrame, keys: list[str], position: str, partition_by: Sequence[str], name: str, empty: Callable) -> DataFrame:
    """Rows of each partition value through a buffer in position order; a task holds what is in the buffer."""
    parts, kind = list(partition_by), added(df, name, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buffer, n = None, empty(), 0
        rows: pa.Table | None = None
        for batch in batches:
            start = 0 if rows is None else len(rows)
            more = pa.Table.from_batches([batch])
            rows = more if rows is None else pa.concat_tables([rows, more])
            out: list[int] = []
            numbers: list[int] = []
            for k, (part, key) in enumerate(zip(comparable(batch, parts), comparable(batch, keys), strict=True)):
                if part != now:
                    left = list(buffer.flush())
                    out += left
                    numbers += range(n, n + len(left))
                    now, n = part, 0
                for r in buffer.put(key, start + k):
                    out.append(r)
                    numbers.append(n)
                    n += 1
            yield from numbered(rows, out, numbers, name)
            live = buffer.rows()
            if len(rows) > 2 * len(live) + len(batch):  # let go of rows that went out
                rows = rows.take(pa.array(live, pa.int64())).combine_chunks()
                buffer.renumber({r: i for i, r in enumerate(live)})
        if rows is not None:
            left = list(buffer.flush())
            yield from numbered(rows, left, list(range(n, n + len(left))), name)

    return _in_order(df, parts, position).mapInArrow(run, kind)


def comparable(batch: pa.RecordBatch, cols: Sequence[str]) -> list[tuple]:
    """For each row a tuple of its values that can be compared: null first, NaN last, each equal to itself."""
    lists = []
    for c in cols:
        col = batch.column(batch.schema.get_field_index(c))
        lists.append([(0,) if v is None else (1, v) if v == v else (2,) for v in col.to_pylist()])
    return list(zip(*lists, strict=True)) if lists else [()] * batch.num_rows


def numbered(rows: pa.Table, at: list[int], numbers: list[int], name: str) -> Iterator[pa.RecordBatch]:
    if at:
        out = rows.take(pa.array(at, pa.int64()))
        yield from out.append_column(name, pa.array(numbers, pa.int64())).combine_chunks().to_batches()


def added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of df and a column more; its name must be free."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _in_order(df: DataFrame, parts: Sequence[str], position: str) -> DataFrame:
    """Rows of a partition value together and in position order."""
    dealt = df.repartition(*parts) if parts else df.repartition(1)  # not coalesce: what makes the rows stays parallel
    return dealt.sortWithinPartitions(*parts, position)


def cluster_runs(df: DataFrame, key: str, position: str, partition_by: Sequence[str], name: str = "cluster_id", buffer_size: int = 0, cascade: bool = False) -> DataFrame:
    """Splits each partition value's rows into sorted runs, first fit: a row goes to the first run whose last key is not
    above its own, or opens a run. The runs' last keys fall from run to run, so that run is found by bisection.

    Rows stream through in position order; a task holds the last keys of the runs of one partition value. Without
    partition_by all rows are one sequence, as for the runs of an external sort. buffer_size
    puts a bounded sort before, which makes fewer runs (and drops the older of equal keys that meet in the buffer);
    cascade makes it several buffers behind each other.
    """
    if buffer_size:
        emitted = free_names([*df.columns, name], "__emitted")[0]
        df = (cascaded_sort if cascade else bounded_sort)(df, [key], position, buffer_size, partition_by, emitted)
        return cluster_runs(df, key, emitted, partition_by, name).drop(emitted)
    parts, kind = list(partition_by), added(df, name, T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tails = None, []
        for batch in batches:
            ids = []
            for part, value in zip(comparable(batch, parts), comparable(batch, [key]), strict=True):
                if part != now:
                    now, tails = part, []
                ids.append(first_fit(tails, value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int32())], names=[*batch.schema.names, name])

    return _in_order(df, parts, position).mapInArrow(run, kind)


def first_fit(tails: list[_Down], value) -> int:
    """The run that takes the value, whose last value it becomes."""
    k = bisect_right(tails, _Down(value))
    k -= k > 0 and not tails[k - 1].value > value
    tails[k : k + 1] = [_Down(value)]
    return k


class _Down:
    """A value in falling order."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __lt__(self, other: _Down) -> bool:
        return other.value < self.value


def external_sort(df: DataFrame, keys: list[str], run_col: str, position: str) -> DataFrame:
    """Sorts by keys and keeps duplicates; ties as a merge of first-fit runs leaves them: later run first."""
    return df.orderBy(*[F.col(k) for k in keys], F.col(run_col).desc(), F.col(position))


class OrderedSet:
    """An ordered set of rows by key: of equal keys the last put in is kept. Every method is a query."""

    def __init__(self, df: DataFrame, key: str, position: str):
        self.key, self.position = key, position
        rest = [c for c in df.columns if c != key]
        row = free_names(df.columns, "__row")[0]
        last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(position)).alias(row))
        self.df = last.select(*[F.col(c) if c == key else F.col(f"{row}.{c}").alias(c) for c in df.columns])

    def insert(self, rows: DataFrame) -> OrderedSet:
        return OrderedSet(self.df.unionByName(rows), self.key, self.position)

    def delete(self, keys: DataFrame) -> OrderedSet:
        return self._of(self.df.join(keys.select(self.key), self.key, "left_anti"))

    def delete_min(self) -> OrderedSet:
        return self._without(F.min(self.key))

    def delete_max(self) -> OrderedSet:
        return self._without(F.max(self.key))

    def get(self, keys: DataFrame) -> DataFrame:
        return self.df.join(keys.select(self.key), self.key, "left_semi")

    def has(self, value) -> bool:
        return bool(self.df.where(F.col(self.key) == F.lit(value)).limit(1).count())

    def bounds(self) -> DataFrame:
        """min, max and len in one pass."""
        return self.df.agg(F.min(self.key).alias("min"), F.max(self.key).alias("max"), F.count("*").alias("len"))

    def clear(self) -> OrderedSet:
        return self._of(self.df.limit(0))

    def clone(self) -> OrderedSet:
        return self._of(self.df)

    def _without(self, end: Column) -> OrderedSet:
        last = free_names(self.df.columns, "__end")[0]
        one = self.df.agg(end.alias(last))  # one row
        return self._of(self.df.join(F.broadcast(one), F.col(self.key) == F.col(last), "left_anti"))

    def _of(self, df: DataFrame) -> OrderedSet:
        out = object.__new__(OrderedSet)
        out.key, out.position, out.df = self.key, self.position, df
        return out
