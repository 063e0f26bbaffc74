"""Ledger totals as a stream: an extension beside the batch ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of usage_log as they arrive."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def windowed(log: DataFrame, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Spend per window and kind; entries up to ``late`` behind count in their window, repeated ids count once."""
    once = log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    spent = F.sum(F.coalesce("cost_reported_usd", "cost_est_usd"))
    return once.groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("entries"), F.round(spent, 6).alias("usd")).select(F.col("window.start").alias("start"), "kind", "entries", "usd")
