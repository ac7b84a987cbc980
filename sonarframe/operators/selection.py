"""Exact order statistics of large groups, all at once, without a sort and without a group in a task.

A group's values are counted by ranges: first by sign and power of two, then, where a wanted value lies, by equal parts
of what the values of that range span.  Each round is one pass over the rows, with sums made inside tasks, and
what a range holds shrinks to one value or to few.  As a range within a power of two has at most 2^52 doubles and a round
parts it by BINS, some six rounds are enough whatever the values are; ranges of SMALL values or fewer are looked at as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import beside, staged

#: Parts of a range, and values that are looked at together.
BINS, SMALL = 1024, 4096


def _power(v: Column) -> Column:
    """A number for the sign and the power of two of v, in the order of values; logarithms do not fall where values rise."""
    size = F.least(F.coalesce(F.floor(F.log2(F.abs(v))), F.lit(-1075)), F.lit(1025)) + 1100
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _counts(rows: DataFrame, by: Sequence[str], bin_: Column) -> DataFrame:
    return rows.groupBy(*by, bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def _found(wanted: DataFrame, counts: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, k, and of the range in which the k-th value lies how many values are less (_off), its values (_n) and ends; a window over the ranges of a group."""
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    off = F.col("_off") if "_off" in by else F.lit(0)
    cells = counts.withColumn("_before", off + before).select(*by, F.col("_before").alias("_less"), "_n", "_lo", "_hi")
    cells = cells.withColumnRenamed("_off", "_old") if "_off" in by else cells.withColumn("_old", F.lit(0).cast("bigint"))
    ask = wanted.select(*(F.col(k).alias(f"_{k}") for k in keys), "k", *(["_off"] if "_off" in by else []))
    same = (F.col("_off") == F.col("_old")) if "_off" in by else F.lit(True)
    for k in keys:
        same = same & F.col(f"_{k}").eqNullSafe(F.col(k))
    hit = cells.join(ask, same).where((F.col("k") >= F.col("_less")) & (F.col("k") < F.col("_less") + F.col("_n")))
    return hit.select(*keys, "k", F.col("_less").alias("_off"), "_n", "_lo", "_hi")


def _rows(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(*keys, v.alias("_v")).where("_v is not null and not isnan(_v)")


def powers(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """The first round's counts, which also say how many values each group has; null and NaN are no values."""
    return staged(_counts(_rows(df, keys, value), keys, _power(F.col("_v"))), "powers")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str | Column, wanted: DataFrame, first: DataFrame | None = None, small: int = SMALL, bins: int = BINS) -> DataFrame:
    """keys, k, v, less and equal for wanted (keys, k): the k-th value (from 0) of each group, how many are less and how many equal.

    A k beyond a group's values has no row; one that is asked for twice has one.  first: powers() of the same, if there already.
    """
    rows = _rows(df, keys, value)
    asked = wanted.select(*keys, F.col("k").cast("bigint").alias("k")).distinct()
    at = staged(_found(asked, powers(df, keys, value) if first is None else first, keys, keys), "ranges")
    done = at.where("_lo = _hi").select(*keys, "k", F.col("_lo").alias("v"), F.col("_off").alias("less"), F.col("_n").alias("equal"))
    few = at.where(f"_lo < _hi and _n <= {small}")
    large = at.where(f"_lo < _hi and _n > {small}")
    by = [*keys, "_off"]

    def within(at: DataFrame) -> DataFrame:
        nodes = at.select(*keys, "_off", "_lo", "_hi").distinct()
        return beside(rows, nodes, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))

    rounds = 0
    while not large.isEmpty():
        rounds += 1
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        counts = _counts(within(large), by, part)
        at = staged(_found(large, counts, by, keys), "ranges")
        done = done.unionByName(at.where("_lo = _hi").select(*keys, "k", F.col("_lo").alias("v"), F.col("_off").alias("less"), F.col("_n").alias("equal")))
        few, large = few.unionByName(at.where(f"_lo < _hi and _n <= {small}")), at.where(f"_lo < _hi and _n > {small}")
    few = staged(few, "few") if rounds else few
    if few.isEmpty():
        return done
    lists = within(few).groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_all"))  # of `small` values at most
    ask = few.select(*(F.col(k).alias(f"_{k}") for k in keys), "k", F.col("_off").alias("_o"))
    same = F.col("_off") == F.col("_o")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    got = lists.join(ask, same).withColumn("v", F.get("_all", (F.col("k") - F.col("_off")).cast("int")))
    less = F.col("_off") + F.size(F.filter("_all", lambda x: x < F.col("v")))
    got = got.select(*keys, "k", "v", less.cast("bigint").alias("less"), F.size(F.filter("_all", lambda x: x == F.col("v"))).cast("bigint").alias("equal"))
    return done.unionByName(got)


def medians(df: DataFrame, keys: Sequence[str], **values: str | Column) -> DataFrame:
    """keys and the median of each of the values, by name: the mean of the middle two; a group without values has no row, a value without any null."""
    melted = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(name).alias("_which"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("_x")) for name, v in values.items()))).alias("_m")).select(*keys, "_m._which", "_m._x")
    own = [*keys, "_which"]
    first = powers(melted, own, "_x")
    n = first.groupBy(*own).agg(F.sum("_n").alias("_all"))
    wanted = n.select(*own, F.explode(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))).alias("k"))
    found = order_statistics(melted, own, "_x", wanted, first)
    middle = (F.min("v") * 0.5 + F.max("v") * 0.5).alias("_middle")  # of one or two
    found = found.groupBy(*own).agg(middle)
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_which") == name, F.col("_middle"))).alias(name) for name in values))
