"""Positions, neighbours and running sums over one total order, without putting all rows into one task.

Rows are range-partitioned by the order and sorted there; what a partition must know of those before it is one row for
each partition, which is broadcast: its size is bounded by the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstream.functions.names import free_names
from rillstream.plans.scratch import staged

def chunks(df: DataFrame, order: list[Column], pid: str, at: str) -> DataFrame:
    """df in range partitions with the partition's number and the row's place in it; staged, so both stay put."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return staged(dealt.select("*", F.spark_partition_id().alias(pid), place.alias(at)), "ranges")


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with a gapless rank from 1 in the order; the order must be total for reruns to agree."""
    pid, at, n, start = free_names([*df.columns, name], "__pid", "__at", "__n", "__start")
    dealt = chunks(df, order, pid, at)
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = dealt.groupBy(pid).agg(F.count("*").alias(n))
    starts = sizes.select(pid, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    ranked = dealt.join(F.broadcast(starts), pid)
    return ranked.select(*df.columns, (F.col(start) + F.col(at) + 1).cast("long").alias(name))


def with_previous(df: DataFrame, order: list[Column], values: dict[str, Column], first: str | None = None) -> DataFrame:
    """df with columns that hold the given values of the row before (null in the first row); `first`, if named, tells
    whether a row is the first one."""
    pid, at, own, last, carried, lead, prev = free_names([*df.columns, *values, first or ""], "__pid", "__at", "__own", "__last", "__carried", "__lead", "__prev")
    dealt = chunks(df.select("*", F.struct(*[c.alias(n) for n, c in values.items()]).alias(own)), order, pid, at)
    lasts = dealt.groupBy(pid).agg(F.max_by(own, at).alias(last))
    by_pid = Window.orderBy(pid)  # one row for each partition
    ends = lasts.select(pid, F.lag(last).over(by_pid).alias(carried), (F.row_number().over(by_pid) == 1).alias(lead))
    inside = Window.partitionBy(pid).orderBy(at)
    out = dealt.join(F.broadcast(ends), pid).withColumn(prev, F.when(F.col(at) == 0, F.col(carried)).otherwise(F.lag(own).over(inside)))
    more = [((F.col(at) == 0) & F.col(lead)).alias(first)] if first else []
    return out.select(*df.columns, *[F.col(f"{prev}.{n}").alias(n) for n in values], *more)


def with_sum_before(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before."""
    pid, at, v, t, start = free_names([*df.columns, name], "__pid", "__at", "__v", "__t", "__start")
    dealt = chunks(df.withColumn(v, value), order, pid, at)
    totals = dealt.groupBy(pid).agg(F.sum(v).alias(t))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = totals.select(pid, F.coalesce(F.sum(t).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(pid).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), pid)
    return out.select(*df.columns, (F.col(start) + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(name))
