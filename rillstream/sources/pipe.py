"""A pipe from code that pushes records to a stream that is read while it is written."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillstream.plans.scratch import scratch_path


class PipeStopped(Exception):
    """The pipe takes no more records."""


class RecordPipe:
    """push() records on one side, stream() on the other; stop() ends it.

    Records are numbered (`pos`) and go to the shared scratch folder in files of `chunk`, which Spark's file source takes
    up in order, one a batch. A pipe that was attached to its query waits in push() while `room` records or more have
    been written that the query has not read yet.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType | str, chunk: int = 1000, room: int = 10_000):
        kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.spark, self.chunk, self.room = spark, chunk, room
        self.schema = T.StructType([T.StructField("pos", T.LongType()), *kind.fields])
        self.path = scratch_path(spark, "pipe")
        self.lock, self.held = threading.Lock(), []
        self.pushed = self.written = 0
        self.stopped, self.query = False, None
        spark.createDataFrame([], self.schema).write.parquet(self.path)

    def push(self, *record) -> None:
        with self.lock:
            if self.stopped:
                raise PipeStopped
            self.held.append((self.pushed, *record))
            self.pushed += 1
            if len(self.held) >= self.chunk:
                self._wait()
                self._write()

    def stop(self) -> None:
        """Writes what is left; after that push() raises. Stopping twice does nothing."""
        with self.lock:
            if not self.stopped:
                self._write()
                self.stopped = True

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    def attach(self, query: StreamingQuery) -> RecordPipe:
        """Lets the pipe know who reads it."""
        self.query, self.read, self.batch = query, 0, -1
        return self

    def _write(self) -> None:
        if self.held:
            rows = self.spark.createDataFrame(self.held, self.schema).coalesce(1)
            rows.write.mode("append").parquet(self.path)
            self.written += len(self.held)
            self.held = []

    def _wait(self) -> None:
        while self.query is not None and self.query.isActive:
            for p in self.query.recentProgress:
                if p.batchId > self.batch:
                    self.batch, self.read = p.batchId, self.read + p.numInputRows
            if self.written - self.read < self.room:
                return
            time.sleep(0.02)
