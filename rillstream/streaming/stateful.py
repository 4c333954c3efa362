"""Streaming twins of the ordered operators, with state for each key and a watermark to bound it.

Rows travel as one struct column beside what Python looks at, and long numbers in it as text: pandas would make nullable
ones floating-point numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillstream.functions.names import free_names
from rillstream.operators.order import _Down, added, first_fit
from rillstream.plans.scratch import scratch_path


def cluster_runs_stream(df: DataFrame, keys: list[str], value: str, position: str, name: str = "cluster_id", ttl_ms: int | None = None) -> DataFrame:
    """First-fit run ids over a stream. The state of a key is the last value of each of its runs; a key silent for
    ttl_ms (processing time) is forgotten and starts anew."""
    added(df, name, T.IntegerType())
    own = free_names([], *[f"key{i}" for i in range(len(keys))])
    read = {c: (lambda v: None if v is None else int(v)) if isinstance(df.schema[c].dataType, T.LongType) else (lambda v: v) for c in (value, position)}
    kind = T.StructType([T.StructField("row", packed_type(df)), T.StructField("run", T.IntegerType())])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tails = [_Down(ordered(v)) for v in state.get[0]] if state.exists else []
        rows = [r for frame in frames for r in frame["row"]]  # a key's rows of one micro-batch
        rows.sort(key=lambda r: ordered(read[position](r[position])))
        runs = [first_fit(tails, ordered(read[value](r[value]))) for r in rows]
        state.update(([t.value[1] if len(t.value) > 1 else None if t.value == (0,) else float("nan") for t in tails],))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        if rows:
            yield pd.DataFrame({"row": pd.Series(rows, dtype=object), "run": pd.Series(runs, dtype="int32")})

    held = T.StructType([T.StructField("tails", T.ArrayType(df.schema[value].dataType))])
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], packed(df).alias("row"))
    found = rows.groupBy(*own).applyInPandasWithState(run, kind, held, "append", timeout)
    return found.select(*unpacked("row", df), F.col("run").alias(name))


def packed(df: DataFrame) -> Column:
    """The row as a struct, long numbers as text."""
    return F.struct(*[(F.col(f.name).cast("string") if isinstance(f.dataType, T.LongType) else F.col(f.name)).alias(f.name) for f in df.schema.fields])


def packed_type(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.LongType) else f.dataType) for f in df.schema.fields])


def unpacked(row: str, df: DataFrame) -> list[Column]:
    return [F.col(f"{row}.`{f.name}`").cast(f.dataType).alias(f.name) for f in df.schema.fields]


def ordered(v) -> tuple:
    """A value that compares with others: null first, NaN last."""
    return (0,) if v is None else (1, v) if v == v else (2,)


def sessions_stream(df: DataFrame, keys: list[str], ts: str, max_idle: str) -> DataFrame:
    """Sessions of keys over a stream: start, end and number of events, once the watermark has passed them.

    session_window joins events exactly the gap apart; a gap of a microsecond less makes silence of max_idle end one.
    """
    gap = f"{_micros(max_idle) - 1} microseconds"
    sessions = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ping"), F.max(ts).alias("last_ping"), F.count("*").alias("pings"))
    return sessions.select(*keys, "first_ping", "last_ping", "pings")


def _micros(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}[unit.rstrip("s")]


def ordered_stream(df: DataFrame, keys: list[str], ts: str, tie: str, name: str = "emitted") -> DataFrame:
    """Rows of each key in (ts, tie) order, numbered from 0: a row is held until the watermark passes it. df must have a
    watermark on ts, which bounds what is held."""
    added(df, name, T.LongType())
    cols = df.columns
    own = free_names([ts], *[f"key{i}" for i in range(len(keys))], "at", "row")
    *key_cols, at_col, row_col = own
    kind = T.StructType([T.StructField("row", packed_type(df)), T.StructField("n", T.LongType())])

    by, whole = cols.index(tie), isinstance(df.schema[tie].dataType, T.LongType)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = ([(h[0], tuple(h[1])) for h in state.get[0]], state.get[1]) if state.exists else ([], 0)
        for frame in frames:
            held += [(int(a), tuple(r[c] for c in cols)) for a, r in zip(frame[at_col], frame[row_col], strict=True)]
        held.sort(key=lambda h: (h[0], ordered(int(h[1][by]) if whole and h[1][by] is not None else h[1][by])))
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sum(a <= mark for a, _ in held)
        out, held = held[:ready], held[ready:]
        state.update((held, n + ready))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            rows = [dict(zip(cols, r, strict=True)) for _, r in out]
            yield pd.DataFrame({"row": pd.Series(rows, dtype=object), "n": range(n, n + ready)})

    one = T.StructType([T.StructField("at", T.LongType()), T.StructField("row", packed_type(df))])
    kept = T.StructType([T.StructField("held", T.ArrayType(one)), T.StructField("n", T.LongType())])
    # The time itself goes along: its watermark must reach the operator. Rows without time have no order and are left out.
    rows = df.where(F.col(ts).isNotNull()).select(F.col(ts), *[F.col(k).alias(o) for k, o in zip(keys, key_cols, strict=True)], F.unix_micros(F.col(ts).cast("timestamp")).alias(at_col), packed(df).alias(row_col))
    found = rows.groupBy(*key_cols).applyInPandasWithState(run, kind, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*unpacked("row", df), F.col("n").alias(name))


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Runs a streaming query over what is there and returns all it put out."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
