"""Tables written to the folder that the driver and all executors share, to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode and where none is set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not at:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="rillstream-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/rillstream-{sc.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, gather: bool = False) -> DataFrame:
    """Writes df to the scratch folder and reads it back; what reads it again needs none of what made it.

    gather is for slim rows made by tasks that read wide ones: a rebalancing shuffle puts them into files of Spark's
    advisory size instead of one small file for each task.
    """
    path = scratch_path(df.sparkSession, label)
    (df.hint("rebalance") if gather else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Removes what staged() wrote; for tables that nothing reads any more."""
    path, spark = getattr(df, "_staged_at", None), df.sparkSession
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
