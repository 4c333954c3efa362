"""JSON record sources: one value a line, or values written one after the other; and generated records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newline-delimited JSON with a schema; a line that is none fails the job. Gzip is told by the file's name."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_values(text: str) -> Iterator[tuple[str | None, str | None]]:
    """(value as JSON text, error) of values written one after the other, with any white space between them."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at == len(text):
            return
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError as e:
            yield None, str(e)
            return
        yield text[at:end], None
        at = end


def read_values(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """path, pos, value, err: every JSON value of each file in order. A value that can't be read ends its file with err.

    Values may span lines, so a file is one task's work; use read_lines for newline-delimited files of any size.
    arrays: an array stands for its elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                rows: list[tuple] = []
                for value, err in json_values(text):
                    if arrays and value is not None and value.startswith("["):
                        rows += [(json.dumps(v), None) for v in json.loads(value)]
                    else:
                        rows.append((value, err))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                    names=["path", "pos", "value", "err"],
                )

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInArrow(run, "path string, pos long, value string, err string")


def pipe(spark: SparkSession, write: Callable[[Callable], None], schema: T.StructType | str) -> DataFrame:
    """Records pushed by write(push) as a stream with a position column `pos`; writing ends when write returns."""
    rows: list = []
    write(rows.append)
    return literal(spark, rows, schema)


def literal(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """Given rows with their position `pos`."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    numbered = [(k, *(r if isinstance(r, tuple | list) else [r[f.name] for f in kind.fields] if isinstance(r, dict) else [r])) for k, r in enumerate(rows)]
    return spark.createDataFrame(numbered, T.StructType([T.StructField("pos", T.LongType()), *kind.fields]))


def ascending(spark: SparkSession, n: int) -> DataFrame:
    """1 to n."""
    return spark.range(1, n + 1).select((F.col("id") - 1).alias("pos"), F.col("id").alias("val"))


def descending(spark: SparkSession, n: int) -> DataFrame:
    """n down to 0."""
    return spark.range(n + 1).select(F.col("id").alias("pos"), (F.lit(n) - F.col("id")).alias("val"))


def _hashed(*parts: Column) -> Column:
    """60 bits of a digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def random_values(spark: SparkSession, most: int, n: int, seed: int = 1) -> DataFrame:
    """n numbers from 0 to most - 1, the same for the same seed."""
    return spark.range(n).select(F.col("id").alias("pos"), (_hashed(F.lit(seed), F.col("id")) % most).alias("val"))


def random_events(spark: SparkSession, ids: int, days: float, n: int, seed: int = 1) -> DataFrame:
    """Events of about normally distributed ids at whole hours within the days after 2000-01-01 01:01:01."""
    one = lambda k: (_hashed(F.lit(seed), F.lit(k), F.col("id")) % (1 << 30) + 1) / F.lit(float((1 << 30) + 1))
    normal = F.sqrt(-2 * F.ln(one(1))) * F.cos(2 * F.pi() * one(2))
    who = F.format_string("%05d", (normal * F.sqrt(F.lit(float(ids))) + ids / 2).cast("int"))
    when = F.timestamp_seconds(F.lit(946688461) + 3600 * F.floor(one(3) * 24 * days))
    return spark.range(n).select(F.col("id").alias("pos"), who.alias("id"), when.alias("event_time"))
