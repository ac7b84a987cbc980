"""A recording handed out in chunks, as a live source would: files for a streaming query, or numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chunked(samples: DataFrame, size: int, by: str = "stream") -> DataFrame:
    """Adds chunk; an incomplete chunk at the end is withheld."""
    n = F.max("idx").over(Window.partitionBy(by)) + 1
    return samples.withColumn("chunk", F.floor(F.col("idx") / size).cast("bigint")).withColumn("_n", n).where((F.col("chunk") + 1) * size <= F.col("_n")).drop("_n")


def write(samples: DataFrame, path: str, size: int, by: str = "stream") -> None:
    """A file of rows for each chunk."""
    chunked(samples, size, by).repartition("chunk").write.partitionBy("chunk").parquet(path)


def read(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """The chunks as a stream of so many files a batch; with trigger(availableNow=True) as fast as they can be read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("basePath", path).parquet(f"{path}/chunk=*")
