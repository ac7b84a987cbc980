"""Signal, marker and spectrogram views of the driver's tables; every row carries an explicit position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, idx (from 0 within the stream), ts, v and the marker label of each sample."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idx = (F.row_number().over(order) - 1).cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), idx.alias("idx"), "ts", F.col("value").alias("v"), F.col("event_type").alias("label"), "event_id")


def wide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x (array of double) and label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("bigint").alias("y"))


def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, bin (from 0) and v in long form."""
    return wide_frames(spark, sf_dir).select("frame", F.posexplode("x").alias("bin", "v")).select("frame", F.col("bin").cast("bigint").alias("bin"), "v")
