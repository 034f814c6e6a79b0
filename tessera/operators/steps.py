"""Where a plan is cut: a result that is used several times, or by the next of many steps, is written first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where there is none and all of Spark runs in one process, a new local one; on
    a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step", by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has so many rows at most; else as it is, for a merge join."""
    counted = df.limit(rows + 1).count()
    return F.broadcast(df) if counted <= rows else df.hint("merge")
