"""Liveness of keys: how long they stay without a sign of life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstream.functions.names import free_names


def idle_sessions(df: DataFrame, keys: list[str], ts: str, max_idle_us: int, tie: str | None = None, name: str = "session_id") -> DataFrame:
    """df with the number of its key's session: silence of max_idle_us or more ends one.

    A gap of exactly the limit ends the session, unlike session_window, which would join it.
    """
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(w))
    new = free_names([*df.columns, name], "__new")[0]
    fresh = df.withColumn(new, F.when(gap >= max_idle_us, 1).otherwise(0))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return fresh.withColumn(name, F.sum(new).over(running).cast("long")).drop(new)


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def idle_alarms(df: DataFrame, keys: list[str], ts: str, max_idle_us: int, now: Column) -> DataFrame:
    """For each key its last sign of life, and whether by `now` it has been silent for max_idle_us or more."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("last_ping"))
    left = F.lit(max_idle_us) - (micros(now) - micros(F.col("last_ping")))
    return last.withColumn("remaining_us", F.greatest(left, F.lit(0))).withColumn("idle", left <= 0)


def liveness_index(df: DataFrame, keys: list[str], ts: str, max_idle_us: int, now: Column, closed: Column | None = None) -> DataFrame:
    """The index of keys as of `now`: how often each was created (a sign of life after silence creates it anew), its last
    sign of life and whether it is alive. `closed`: when all were closed at once; a key is created anew by what follows.

    One shuffle by key; of a key only times are sorted.
    """
    own, when, late = free_names(keys, "__at", "__when", "__late")
    pings = df.where(F.col(ts) <= now).select(*keys, micros(F.col(ts)).alias(own))
    w = Window.partitionBy(*keys).orderBy(own)
    gap = F.col(own) - F.lag(own).over(w)
    fresh = gap.isNull() | (gap >= max_idle_us)
    end = micros(closed) if closed is not None else F.lit(None).cast("long")
    fresh = fresh | F.coalesce((F.lag(own).over(w) <= end) & (F.col(own) > end), F.lit(False))
    found = pings.withColumn(when, fresh.cast("long")).groupBy(*keys).agg(F.sum(when).alias("created"), F.max(own).alias(late))
    alive = (micros(now) - F.col(late) < max_idle_us) & ~F.coalesce(F.col(late) <= end, F.lit(False))
    return found.select(*keys, "created", F.timestamp_micros(late).alias("last_ping"), alive.alias("alive"))
