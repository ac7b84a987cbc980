"""Correlations, ranks, moments and rank tests, by group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import medians
from .staging import FEW, sized, staged

#: Value ranges into which ranking cuts each group.
PARTS = 64


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate; null where either side does not vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread))


def by_bin(df: DataFrame, a: str, b: str, by: str = "bin") -> DataFrame:
    """bin and r."""
    return df.groupBy(by).agg(pearson(a, b).alias("r"))


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, population std and median of the values that are there; NaN counts as missing."""
    x = F.when(~F.isnan(value), F.col(value))
    grouped = (df.groupBy(*by) if by else df.groupBy()).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    middle = medians(df, by, median=x)
    if not by:
        return grouped.join(F.broadcast(middle), how="left")
    middle = middle.select(*(F.col(k).alias(f"_{k}") for k in by), "median")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by))
    return grouped.join(middle, same, "left").drop(*(f"_{k}" for k in by))


def ranks(df: DataFrame, value: str, by: str, name: str = "rank") -> DataFrame:
    """df with the average rank (from 1) of the value within its group; null values have none.

    Equal values are counted before anything is sorted, and each group is cut into ranges of values by
    approximate quantiles, so that neither a group nor a frequent value makes one large task.  The ranks are exact.
    The quantiles depend on the order in which tasks' summaries meet, so they are worked out once and kept.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    cuts = counted.groupBy(by).agg(F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)], 1000).alias("_cuts"))
    cut = counted.join(sized(staged(cuts, "cuts"), FEW // PARTS), by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    before = cut.groupBy(by, "_part").agg(F.sum("_c").alias("_all"))
    before = before.withColumn("_before", F.coalesce(F.sum("_all").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    within = F.coalesce(F.sum("_c").over(Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("_within", within).join(before, [by, "_part"])
    ranked = ranked.select(by, value, (F.col("_before") + F.col("_within") + (F.col("_c") + 1) / 2).alias(name))
    return df.join(ranked, [by, value], "left")


def ranks_outside(df: DataFrame, value: str, by: str, k: int, name: str, fold: str = "fold") -> DataFrame:
    """df with an array of k average ranks of the value: the p-th is as ranks() of the group's rows outside of fold p has it.

    A value's rows are counted once for all folds, so rows are not repeated for the folds whose rest they are in.
    """
    folds = range(k)
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(*(F.count_if(F.col(fold) != p).alias(f"_c{p}") for p in folds))
    cuts = counted.groupBy(by).agg(F.percentile_approx(value, [k / PARTS for k in range(1, PARTS)], 1000).alias("_cuts"))
    cut = counted.join(sized(staged(cuts, "cuts"), FEW // PARTS), by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(by, "_part").agg(*(F.sum(f"_c{p}").alias(f"_c{p}") for p in folds)).select(by, "_part", *(F.coalesce(F.sum(f"_c{p}").over(earlier), F.lit(0)).alias(f"_b{p}") for p in folds))
    ranked = cut.select(by, value, "_part", *(f"_c{p}" for p in folds), *(F.coalesce(F.sum(f"_c{p}").over(within), F.lit(0)).alias(f"_w{p}") for p in folds)).join(before, [by, "_part"])
    ranked = ranked.select(by, value, F.array(*(F.col(f"_b{p}") + F.col(f"_w{p}") + (F.col(f"_c{p}") + 1) / 2 for p in folds)).alias(name))
    return df.join(ranked, [by, value], "left")


def spearman(df: DataFrame, by: str, x: str, target: str, ranked: bool = False) -> DataFrame:
    """by and rho of x against the target; 0 where either does not vary.  Sums near zero count as no signal.

    ranked: the target is ranks already, for a target that all groups share; see target_ranks().
    """
    both = ranks(df.withColumn("_rt", F.col(target)) if ranked else ranks(df, target, by, "_rt"), x, by, "_rx")
    return of_ranks(both, x, by)


def of_ranks(both: DataFrame, x: str, *by: str) -> DataFrame:
    """by and rho of rows with the ranks _rx of x and _rt of the target."""
    rho = both.groupBy(*by).agg(pearson("_rx", "_rt").alias("rho"), F.sum(x).alias("_s"))
    return rho.select(*by, F.when(F.abs("_s") < 1e-8, 0.0).otherwise(F.coalesce("rho", F.lit(0.0))).alias("rho"))


def target_ranks(df: DataFrame, target: str, name: str) -> DataFrame:
    """df, a row for each target, with the target's rank: ranked once, before the features become rows."""
    return ranks(df.withColumn("_one", F.lit(0)), target, "_one", name).drop("_one")


def strongest(rho: DataFrame, by: str, k: int) -> DataFrame:
    """The k features of the largest |rho|, with pos from 0 in ascending order of it; of equal ones the later feature is stronger.

    A row for each feature: this is a sort of as many rows as there are features.
    """
    top = rho.orderBy(F.desc(F.abs("rho")), F.desc(by)).limit(k)
    return top.withColumn("pos", (F.row_number().over(Window.orderBy(F.abs("rho"), by)) - 1).cast("bigint"))


def mann_whitney(df: DataFrame, value: str, first: Column, by: str) -> DataFrame:
    """by, n1, n2, u1, u2, z and two-sided p (normal approximation with ties and continuity) of the group `first` against the rest."""
    d = ranks(df.withColumn("_first", first).where(F.col("_first").isNotNull() & F.col(value).isNotNull()), value, by, "_r")
    sums = d.groupBy(by).agg(F.count_if("_first").alias("n1"), F.count_if(~F.col("_first")).alias("n2"), F.sum(F.when(F.col("_first"), F.col("_r"))).alias("_r1"))
    ties = d.groupBy(by, value).agg(F.count("*").cast("double").alias("_t")).groupBy(by).agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = sums.join(ties, by).withColumn("u1", F.col("_r1") - n1 * (n1 + 1) / 2).withColumn("u2", n1 * n2 - F.col("u1"))
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    out = out.withColumn("z", F.try_divide(F.greatest(F.abs(F.col("u1") - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd))
    return out.withColumn("p", two_sided(F.col("z"))).drop("_r1", "_ties")


def two_sided(z: Column) -> Column:
    """Probability beyond +-z of the normal distribution, z >= 0, by the complementary error function's rational approximation (error below 1.2e-7 of the value)."""
    # Coefficients of the Chebyshev fit of erfc.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x = z / 2**0.5
    t = 1 / (1 + x / 2)
    poly = reduce(lambda acc, k: acc * t + k, reversed(c[:-1]), F.lit(c[-1]))
    return F.least(t * F.exp(-x * x + poly), F.lit(1.0))


def corrected(p: str | Column, tests: int) -> Column:
    """Bonferroni."""
    return F.least(F.col(p) * tests if isinstance(p, str) else p * tests, F.lit(1.0))


def moments(df: DataFrame, x: str, shift: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, sum of outer products) of vectors of equal length, less a shift; each task sends one row.

    What reaches the driver has the size of the matrix, not of the data.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            m = matrix(batch.column(0))
            if not len(m):
                continue
            m = m if shift is None else m - shift
            n += len(m)
            s, g = (m.sum(0), m.T @ m) if s is None else (s + m.sum(0), g + m.T @ m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "g"])

    parts = df.select(F.col(x).cast("array<double>").alias("x")).where("x is not null").mapInArrow(scan, "n bigint, s array<double>, g array<double>")
    cells = parts.select("n", F.concat("s", "g").alias("all")).select("n", F.posexplode("all").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = cells.collect()
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["at"]] = r["v"]
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2 + 0.5)
    return rows[0]["n"], flat[:d], flat[d:].reshape(d, d)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def covariance(df: DataFrame, x: str) -> np.ndarray:
    """The sample covariance matrix; sums are of deviations from the mean of the first pass."""
    n, s, _ = moments(df, x)
    if n < 2:
        return np.full((len(s), len(s)), np.nan)
    n, s, g = moments(df, x, s / n)
    return (g - np.outer(s, s) / n) / (n - 1)
