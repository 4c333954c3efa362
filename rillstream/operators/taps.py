"""Pass-through operators: counting and logging rows on their way."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("rillstream")


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df and an observation whose get[name] is the number of rows once an action has run over df."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias(name)), seen


class RunningCount(StreamingQueryListener):
    """Counts the rows of a stream; `rows` can be read at any time while the stream runs. It follows one stream: tapped()."""

    def __init__(self, spark: SparkSession, name: str = "rows_seen"):
        self.spark, self.name, self.rows = spark, name, 0
        spark.streams.addListener(self)

    def tapped(self, df: DataFrame) -> DataFrame:
        return df.observe(self.name, F.count(F.lit(1)).alias("n"))

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        self.rows += seen["n"] if seen else 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def logged(df: DataFrame, pattern: str = "%s") -> DataFrame:
    """df; every row is written to the executors' log as it passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                log.info(pattern, row)
            yield batch

    return df.mapInArrow(run, df.schema)
