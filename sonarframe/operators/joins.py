"""Joins through time: nearest as-of, intervals, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import carried
from .staging import FEW, sized, staged
from .statistics import PARTS


def nearest(probes: DataFrame, grid: DataFrame, by: str = "stream", at: str = "t", keep: str = "t") -> DataFrame:
    """For each probe the nearest grid row of its stream as `hit`; of two as near ones the earlier.

    A union of both sides, sorted within ranges of times that hold about as many grid rows each, carries the last
    grid row before and the first after; what a range lacks comes from the ends of the ranges around it.  No
    pairs are made and no stream is in one task.  The ranges' ends, which depend on the order in which tasks'
    summaries meet, are worked out once and kept.  Probes of a stream without grid rows have a null hit.  `at` is a number.
    """
    cuts = grid.groupBy(F.col(by).alias("_by")).agg(F.percentile_approx(at, [k / PARTS for k in range(1, PARTS)], 1000).alias("_cuts"))
    a = probes.withColumn("_side", F.lit(1)).withColumn("_g", F.lit(None).cast(f"struct<at:{grid.schema[at].dataType.simpleString()},hit:{grid.schema[keep].dataType.simpleString()}>"))
    b = grid.select(by, F.col(at), F.lit(0).alias("_side"), F.struct(F.col(at).alias("at"), F.col(keep).alias("hit")).alias("_g"))
    both = a.unionByName(b, allowMissingColumns=True).join(sized(staged(cuts, "cuts"), FEW // PARTS), F.col(by).eqNullSafe(F.col("_by")), "left")
    both = both.withColumn("_block", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(at))), F.lit(0))).drop("_by", "_cuts")
    at_grid = F.when(F.col("_g").isNotNull(), F.col(at))
    ends = F.struct(F.max_by("_g", at_grid).alias("last"), F.min_by("_g", at_grid).alias("first"))
    before = lambda w: F.last("_ends.last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = lambda w: F.first("_ends.first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = carried(both, "_ends", ends, lambda w: F.struct(before(w).alias("before"), after(w).alias("after")), by)
    w = Window.partitionBy(by, "_block").orderBy(at, "_side")
    both = both.withColumns({
        "_b": F.coalesce(F.last("_g", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_ends.before")),
        "_a": F.coalesce(F.first("_g", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_ends.after")),
    })
    earlier = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col(at) - F.col("_b.at") <= F.col("_a.at") - F.col(at)))
    return both.where("_side = 1").withColumn("hit", F.when(earlier, F.col("_b.hit")).otherwise(F.col("_a.hit"))).drop("_side", "_g", "_b", "_a", "_block", "_ends")


def in_intervals(samples: DataFrame, intervals: DataFrame, by: str = "stream", bucket: int = 64) -> DataFrame:
    """Samples with each interval [first, end) of their stream that holds them.

    Both sides meet on the stream and the bucket of positions, so the join has equal keys however many
    intervals there are; an interval is repeated once for each bucket that it touches.
    """
    a = samples.withColumn("_bucket", F.floor(F.col("idx") / bucket))
    b = intervals.where("end > first").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor((F.col("end") - 1) / bucket))))
    return a.join(b, [by, "_bucket"]).where("idx >= first and idx < end").drop("_bucket")


def mask(samples: DataFrame, intervals: DataFrame, by: str = "stream", bucket: int = 64) -> DataFrame:
    """Adds inside: whether any interval holds the sample."""
    hit = in_intervals(samples.select(by, "idx"), intervals, by, bucket).select(by, "idx").distinct().withColumn("inside", F.lit(True))
    return samples.join(hit, [by, "idx"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def matching_words(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Words of both sessions with the first occurrence in each, as first_a and first_b."""
    return a.groupBy("word").agg(F.min(order).alias("first_a")).join(b.groupBy("word").agg(F.min(order).alias("first_b")), "word")


def cycled(runs: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """Each run i with the item i mod n_items; items are numbered from 0."""
    return runs.withColumn("item", F.pmod("run", F.lit(n_items))).join(items, "item")


def two_hops(probes: DataFrame, first: DataFrame, second: DataFrame, by: str = "stream", at: str = "t") -> DataFrame:
    """The row of the second grid nearest to the row of the first grid that is nearest to each probe."""
    hop = nearest(probes, first, by, at, at).withColumnRenamed(at, "_probe").withColumnRenamed("hit", at)
    return nearest(hop, second, by, at, at).withColumnRenamed(at, "via").withColumnRenamed("_probe", at)
