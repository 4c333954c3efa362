"""Mapping rows in order through stages that may fail.

A stage is (value column) -> struct<res, err>: err is null where it succeeded. Rows keep the index they came with, so
any work is parallel and order is only a sort by that index.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE, DROP, ABORT = "ignore", "drop", "abort"
Stage = Callable[[Column], Column]


def ordered_map(df: DataFrame, index: str, value: str, stages: Sequence[Stage], errors: str = IGNORE) -> DataFrame:
    """index, res, err: ignore keeps failed rows with their error, drop leaves them out, abort ends with the first one.

    A row that failed skips the stages after. The index of a row is that of its source, whatever was dropped.
    """
    if errors not in (IGNORE, DROP, ABORT):
        raise ValueError(errors)
    out = df.select(F.col(index).alias("index"), F.struct(F.col(value).alias("res"), F.lit(None).cast("string").alias("err")).alias("o"))
    for stage in stages:
        done = stage(F.col("o.res"))
        failed = F.col("o.err").isNotNull()
        res = F.when(~failed, done["res"])
        out = out.select("index", F.struct(res.alias("res"), F.coalesce(F.col("o.err"), F.when(~failed, done["err"])).alias("err")).alias("o"))
    out = out.select("index", "o.res", "o.err")
    if errors == DROP:
        return out.where("err is null")
    if errors == ABORT:
        first = out.where("err is not null").agg(F.min("index").alias("__first"))  # one row
        return out.join(F.broadcast(first), F.col("__first").isNull() | (F.col("index") <= F.col("__first"))).drop("__first")
    return out


def checked(res: Column, failed: Column, message: str | Column) -> Column:
    """A stage's result: res, or the message where failed holds."""
    said = F.lit(message) if isinstance(message, str) else message
    bad = F.coalesce(failed, F.lit(False))
    return F.struct(F.when(~bad, res).alias("res"), F.when(bad, said).alias("err"))


def python_stage(work: Callable, kind: str) -> Stage:
    """A stage of a Python function of one value: what it raises is the row's error. Values go in Arrow batches; a null,
    as failed rows have, is not handed to it."""

    @F.pandas_udf(f"res {kind}, err string")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            if pd.isna(v):
                out.append((None, None))
                continue
            try:
                out.append((work(v), None))
            except Exception as e:
                out.append((None, str(e)))
        frame = pd.DataFrame(out, columns=["res", "err"], dtype=object)
        return frame

    return run
