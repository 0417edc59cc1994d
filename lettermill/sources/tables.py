"""Reading the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_bodies(messages: DataFrame, since: Column | None = None, most: int = 4000) -> DataFrame:
    """Messages with the first characters of their bodies, all that clustering
    needs; reference extraction reads bodies whole. ``since`` reaches the scan."""
    rows = messages if since is None else messages.where(F.col("sent_at") >= since)
    return rows.withColumn("body", F.left("body", F.lit(most)))


def append(df: DataFrame, path: str) -> None:
    """Add rows to a log that is never changed."""
    df.write.mode("append").parquet(path)
