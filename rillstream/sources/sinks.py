"""NDJSON sinks: plain, rolled by size, partitioned, partitioned and clustered, through a cache of open files; gzip or not.

Plain and partitioned sinks use Spark's own writer and its commit protocol. Rolled, clustered and cached files have
names that are part of the contract, so tasks write them, each file once under a hidden name of this attempt, and a
second pass names those that the tasks which ended well report. A bare path belongs to Spark's default file system.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstream.functions.jsontext import json_line, line_bytes
from rillstream.functions.partition import pairs, parse_path, partition_path
from rillstream.operators.rolling import roll_by_size
from rillstream.sources.writers import MANIFEST, WriterCache, publish, qualified

HELD = 32 << 20  # bytes of rows that a task of write_cached brings together


@dataclass(frozen=True)
class Target:
    """Where files go: a base path with prefix and suffix folders, gzip or not."""

    base: str
    gzip: bool = False

    def with_prefix(self, prefix: str) -> Target:
        return Target(f"{self.base.rstrip('/')}/{prefix.strip('/')}", self.gzip)

    def with_suffix(self, suffix: str) -> Target:
        """A folder below the path, as prefixes are."""
        return self.with_prefix(suffix)

    def with_gzip(self) -> Target:
        return Target(self.base, True)

    def named(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}" + (".gz" if self.gzip and not name.endswith(".gz") else "")


def write_lines(df: DataFrame, target: Target, order: Sequence[Column] = ()) -> None:
    """Newline-delimited JSON, nulls kept; in order over the part files if one is given."""
    lines = (df.orderBy(*order) if order else df).select(json_line(df).alias("value"))
    writer = lines.write.mode("overwrite")
    (writer.option("compression", "gzip") if target.gzip else writer).text(target.base)


def write_partitioned(df: DataFrame, target: Target, parts: Sequence[str], max_open: int = 0) -> None:
    """Lines under key=value folders, named and escaped by Spark; a task has max_open files open at most (0: it sorts)."""
    spark = df.sparkSession
    lines = df.select(json_line(df).alias("value"), *[F.coalesce(F.col(p).cast("string"), F.lit("")).alias(p) for p in parts])
    held = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(max_open))
    try:
        writer = lines.write.mode("overwrite").partitionBy(*parts)
        (writer.option("compression", "gzip") if target.gzip else writer).text(target.base)
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", held)


def write_routed(df: DataFrame, target: Target, parts: Sequence[str], position: str, files: int = 1) -> DataFrame:
    """Lines under partition paths with the escaping of partition keys: {parts}/unsorted_records_s{suffix}.json.

    files splits every partition by a hash of the position, so that a large one is not one task's work; the suffix tells
    the files apart. Returns file and rows.
    """
    kvs = pairs(**{p: F.col(p) for p in parts})
    split = F.format_string("%04d", F.pmod(F.xxhash64(position), F.lit(files)).cast("int"))
    named = df.select(unsorted_file(partition_path(kvs), split).alias("file"), F.col(position).alias("pos"), json_line(df).alias("line"))
    return write_files(named, target)


def read_routed(spark: SparkSession, target: Target, schema: str) -> DataFrame:
    """Lines below target, with the pairs of their path as `partitions`."""
    path = F.try_url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))  # Spark shows paths escaped once more
    lines = spark.read.option("recursiveFileLookup", "true").text(target.base).select("value", parse_path(path).alias("partitions"))
    return lines.select(F.from_json("value", schema).alias("v"), "partitions").select("v.*", "partitions")


class MemorySink:
    """Lines kept by Spark (memory first, disk beyond) under paths; what is appended follows what is there. For tests and
    small results: it lasts as long as the application."""

    def __init__(self):
        self.parts: dict[str, list[DataFrame]] = {}

    def append(self, df: DataFrame, path: str) -> None:
        lines = df.select(json_line(df).alias("value")).persist()
        lines.count()
        self.parts.setdefault(path, []).append(lines)

    def read(self, path: str) -> DataFrame:
        """The lines of a path, with the number of the append they came by."""
        out = None
        for k, lines in enumerate(self.parts[path]):
            one = lines.withColumn("part", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    def clear(self) -> None:
        for lines in sum(self.parts.values(), []):
            lines.unpersist()
        self.parts = {}


def memory_view(df: DataFrame, name: str) -> DataFrame:
    """Lines kept by Spark under a view's name."""
    lines = df.select(json_line(df).alias("value")).persist()
    lines.createOrReplaceTempView(name)
    return lines


def by_path(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[dict[str, list[bytes]]]:
    """The lines of each path in the order they come, of one stretch after the other: batches (file, line) of `held` bytes
    in all, one batch at least."""
    lines, size = {}, 0
    for batch in batches:
        if lines and size + batch.nbytes > held:
            yield lines
            lines, size = {}, 0
        for name, line in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            lines.setdefault(name, []).append(line.encode() + b"\n")
        size += batch.nbytes
    if lines:
        yield lines


def write_cached(df: DataFrame, target: Target, path: Column, max_open: int = 0, ttl_s: float = 0, held: int = HELD) -> DataFrame:
    """Each row's line to the file its path names, in the order the task has the rows, without a shuffle: a task keeps up
    to max_open files open and closes the least recently used, or those idle for ttl_s. Paths hold {suffix}, as a file
    may be closed and the path come again. Returns file and rows.

    A task holds `held` bytes of rows and writes them path by path, those of open files first, so that a path is opened
    once for them at most, however its rows alternate with others. Else nearly every row would be a file of its own where
    there are more paths than open files, and the driver, which lists them to read them, would hold them all."""
    base = qualified(df.sparkSession, target.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WriterCache(base, target.gzip, max_open, ttl_s)
        for lines in by_path(batches, held):
            for name in sorted(lines, key=cache.requires_new):
                for line in lines[name]:
                    cache.write(name, line)
            yield cache.finished()
        cache.close()
        yield cache.finished()

    named = df.select(path.alias("file"), json_line(df).alias("line"))
    return publish(named.mapInArrow(run, MANIFEST), base)


def cluster_file(parts: Column, cluster: Column, suffix: str = "") -> Column:
    """{parts}/sorted_records_p0000_s{suffix}.json"""
    return F.concat(parts, F.format_string("sorted_records_p%04d_s%s.json", cluster, F.lit(suffix)))


def unsorted_file(parts: Column, suffix: Column) -> Column:
    return F.concat(parts, F.lit("unsorted_records_s"), suffix, F.lit(".json"))


def write_clustered(df: DataFrame, target: Target, parts: Sequence[str], cluster: str, position: str, suffix: str = "") -> DataFrame:
    """One file for each partition value and cluster, its rows in position order; returns path and number of rows."""
    kvs = pairs(**{p: F.col(p) for p in parts})
    named = df.select(cluster_file(partition_path(kvs), F.col(cluster), suffix).alias("file"), F.col(position).alias("pos"), json_line(df.drop(cluster)).alias("line"))
    return write_files(named, target)


def write_rolled(df: DataFrame, target: Target, position: str, limit: int, base: str) -> DataFrame:
    """base_000000.ndjson and so on, each ended by the row that exceeds limit bytes before compression."""
    lines = df.select(F.col(position).alias("pos"), json_line(df).alias("line"))
    rolled = roll_by_size(lines.withColumn("n", line_bytes(F.col("line"))), "n", "pos", limit)
    return write_files(rolled.select(F.format_string(f"{base}_%06d.ndjson", F.col("file_idx")).alias("file"), "pos", "line"), target)


def write_files(rows: DataFrame, target: Target) -> DataFrame:
    """(file, pos, line) to files below target; returns file and rows written.

    A file's rows come together and in order; a task holds the line it writes. Files of one task follow each other, so
    that one is open at a time.
    """
    base = qualified(rows.sparkSession, target.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WriterCache(base, target.gzip, max_open=1)
        for batch in batches:
            for name, line in zip(batch[0].to_pylist(), batch[2].to_pylist(), strict=True):
                cache.write(name, line.encode() + b"\n")
            yield cache.finished()
        cache.close()
        yield cache.finished()

    ordered = rows.select("file", "pos", "line").repartition("file").sortWithinPartitions("file", "pos")
    return publish(ordered.mapInArrow(run, MANIFEST), base)


def read_back(spark: SparkSession, target: Target, schema: str) -> DataFrame:
    """Lines below target with partition columns as strings."""
    held = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "false").json(target.base)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", held)
