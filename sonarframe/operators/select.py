"""Projections and filters on signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import beside, staged


def exclude_channels(df: DataFrame, channels: Sequence, by: str = "ch") -> DataFrame:
    """The rows of all other channels; the predicate reaches the scan."""
    return df.where(~F.col(by).isin(list(channels)))


def matches_any(name: str | Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern matches: each is anchored to the start before its first and to the end after its last alternative."""
    name = F.col(name) if isinstance(name, str) else name
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(f"^(?:^{p}$)")
    return out


def select_channels(df: DataFrame, patterns: Sequence[str], by: str = "name") -> DataFrame:
    return df.where(matches_any(by, patterns))


def crop_between(df: DataFrame, start: str, end: str, by: str = "stream", label: str = "label") -> DataFrame:
    """Per stream the rows from its first `start` marker up to, but not including, the next `end` marker.

    Streams without a start have no rows; without a later end they run to their last row.
    """
    begins = df.where(F.col(label) == start).groupBy(by).agg(F.min("idx").alias("_first"))
    begins = staged(begins, "begins")
    later = beside(df.where(F.col(label) == end).select(by, "idx"), begins, [by]).where(F.col("idx") > F.col("_first"))
    ends = staged(later.groupBy(by).agg(F.min("idx").alias("_last")), "ends")
    return beside(df, beside(begins, ends, [by], "left"), [by]).where((F.col("idx") >= F.col("_first")) & (F.col("_last").isNull() | (F.col("idx") < F.col("_last")))).drop("_first", "_last")


def parse_markers(df: DataFrame, prefix: str, by: str = "stream") -> DataFrame:
    """Markers that begin with a prefix: the label without it, and seconds since the stream's first row to two digits, half to even."""
    begins = staged(df.groupBy(by).agg(F.min("ts").alias("_begin")), "begins")
    found = beside(df.where(F.col("label").startswith(prefix)), begins, [by])
    hundredths = F.expr("timestampdiff(MICROSECOND, _begin, ts)") / 1e4
    return found.withColumn("seconds", F.bround(hundredths, 0) / 100).drop("_begin").withColumn("word", F.trim(F.expr(f"substring(label, {len(prefix) + 1})")))


def common_duration(df: DataFrame, by: str = "stream") -> DataFrame:
    """All streams cut to the number of samples that the shortest has."""
    shortest = df.groupBy(by).agg(F.max("idx").alias("m")).agg(F.min("m").alias("last"))
    return df.join(F.broadcast(shortest), F.col("idx") <= F.col("last")).drop("last")


def lag_align(df: DataFrame, head: int = 20, tail: int = 4, idx: str = "frame") -> DataFrame:
    """Frames without the first `head` and the last `tail`, numbered anew from 0."""
    n = df.agg((F.max(idx) + 1).alias("n"))
    return df.join(F.broadcast(n), (F.col(idx) >= head) & (F.col(idx) < F.col("n") - tail)).drop("n").withColumn(idx, F.col(idx) - head)


def pick(x: str | Column, positions: Sequence[int]) -> Column:
    """The elements at these positions, in this order."""
    return F.transform(F.array(*map(F.lit, positions)), lambda i: F.get(x, i))


def in_block(idx: str | Column, first: int, samples: int) -> Column:
    """Whether a sample is of the test block that begins at first; its negation is the training mask."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    return (idx >= first) & (idx < first + samples)


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(~F.isnan(c) & F.col(c).isNotNull())
    return df


def stack(parts: Sequence[DataFrame], idx: str = "idx") -> DataFrame:
    """The rows of all parts behind one another; idx goes on from part to part.

    Each part is numbered by the count of those before it, so no row has to be sorted.
    """
    out, before = None, F.lit(0).cast("bigint")
    offsets = None
    for k, part in enumerate(parts):
        size = part.agg(F.coalesce(F.max(idx) + 1, F.lit(0)).alias(f"_n{k}"))
        moved = part if offsets is None else part.join(F.broadcast(offsets)).withColumn(idx, F.col(idx) + before).select(*part.columns)
        out = moved if out is None else out.unionByName(moved)
        offsets = size if offsets is None else offsets.join(F.broadcast(size))
        before = before + F.col(f"_n{k}")
    return out


def end_to_end(df: DataFrame, by: str = "stream", idx: str = "idx") -> DataFrame:
    """All streams behind one another in their order: idx goes on from stream to stream.

    Only the streams' lengths are put in order, a row for each.
    """
    sizes = df.groupBy(by).agg((F.max(idx) + 1).alias("_n"))
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.join(offsets, by).withColumn(idx, F.col(idx) + F.col("_before")).drop("_before")
