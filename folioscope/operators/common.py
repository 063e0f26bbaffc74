"""Helpers shared by the operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows of a side that may be broadcast: a few MB.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most so many (narrow) rows, counted first; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; a local one only in a local session that has none, as in tests. It goes when the session ends."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioscope-checkpoint-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table of the workspace and read from there, so that its plan runs once and executors may be lost."""
    path = workspace(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
