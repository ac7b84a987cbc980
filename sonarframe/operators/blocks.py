"""Windows along a stream without a stream in one task: rows by blocks of their numbers, with what blocks need of each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that a block spans.
BLOCK = 1 << 14


def blocked(df: DataFrame, idx: str, block: int = BLOCK) -> DataFrame:
    """Adds _block."""
    return df.withColumn("_block", F.floor(F.col(idx) / block))


def with_halo(df: DataFrame, idx: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Adds _block: each row is in its own block, and in those with rows that look as far back, or ahead, as to it."""
    return df.withColumn("_block", F.explode(F.sequence(F.floor((F.col(idx) - after) / block), F.floor((F.col(idx) + before) / block))))


def without_halo(df: DataFrame, idx: str, block: int = BLOCK) -> DataFrame:
    return df.where(F.col("_block") == F.floor(F.col(idx) / block)).drop("_block")


def carried(rows: DataFrame, name: str, end: Column, over: Callable[[Window], Column], by: str) -> DataFrame:
    """Adds name to blocked rows: of each block's `end`, an aggregate, what `over` makes along the stream's blocks."""
    ends = rows.groupBy(by, "_block").agg(end.alias(name))
    ends = ends.select(F.col(by).alias("_by"), F.col("_block").alias("_b"), over(Window.partitionBy(by).orderBy("_block")).alias(name))
    return rows.join(ends, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_b"))).drop("_by", "_b")


def previous(df: DataFrame, value: str, name: str, by: str, idx: str, block: int = BLOCK) -> DataFrame:
    """Adds name: the value of the row before in the order of idx; null for a stream's first row."""
    rows = carried(blocked(df, idx, block), "_end", F.max_by(value, idx), lambda w: F.lag("_end").over(w), by)
    w = Window.partitionBy(by, "_block").orderBy(idx)
    return rows.withColumn(name, F.when(F.row_number().over(w) == 1, F.col("_end")).otherwise(F.lag(value).over(w))).drop("_end", "_block")


def running(df: DataFrame, value: str, name: str, by: str, idx: str, block: int = BLOCK) -> DataFrame:
    """Adds name: the sum of the value up to and with the row, in the order of idx."""
    rows = carried(blocked(df, idx, block), "_before", F.sum(value), lambda w: F.sum("_before").over(w.rowsBetween(Window.unboundedPreceding, -1)), by)
    w = Window.partitionBy(by, "_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce("_before", F.lit(0)) + F.sum(value).over(w)).drop("_before", "_block")


def last_known(df: DataFrame, value: Column, name: str, by: str, idx: str, block: int = BLOCK) -> DataFrame:
    """Adds name: the value of the row, or of the last before it that has one."""
    rows = blocked(df.withColumn("_own", value), idx, block)
    rows = carried(rows, "_kept", F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col(idx))), lambda w: F.last("_kept", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), by)
    w = Window.partitionBy(by, "_block").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last("_own", ignorenulls=True).over(w), F.col("_kept"))).drop("_own", "_kept", "_block")
