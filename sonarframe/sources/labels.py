"""Marker files and label files: reading and the lines to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """recorded_at, monotonic_time, label of marker files without a header."""
    return spark.read.csv(path, schema="recorded_at string, monotonic_time double, label string")


def trial_starts(markers: DataFrame, first_timestamp: Column | float, sr: float, prefix: str = "start;", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep, word, seconds (two digits, half to even) and first (its sample) of the markers that begin a trial."""
    at = F.col("monotonic_time") - (first_timestamp if isinstance(first_timestamp, Column) else F.lit(first_timestamp))
    found = markers.where(F.col("label").startswith(prefix)).withColumn("seconds", F.bround(at, 2))
    return found.select(*keep, F.expr(f"substring(label, {len(prefix) + 1})").alias("word"), "seconds", F.floor(F.col("seconds") * sr).cast("bigint").alias("first"))


def two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def interval_lines(runs: DataFrame, flag: str, shift: float = 0.01) -> DataFrame:
    """Adds line: begin and end of an interval of frames in seconds, and 0 or 1."""
    return runs.withColumn("line", F.concat_ws("\t", two(F.col("first") * shift), two(F.col("end") * shift), F.col(flag).cast("int").cast("string")))


def trial_lines(trials: DataFrame, seconds: float) -> DataFrame:
    """Adds line: begin, end and word of a trial (begin, word)."""
    return trials.withColumn("line", F.concat_ws("\t", two(F.col("begin")), two(F.col("begin") + seconds), F.col("word")))


def write_lines(df: DataFrame, path: str, by: str = "stream", order: str = "first") -> None:
    """A folder of text for each stream, its lines in order."""
    df.repartition(by).sortWithinPartitions(by, order).select(by, F.col("line").alias("value")).write.partitionBy(by).text(path)
