"""Codebooks of spectrogram bins, and putting values into their levels and back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import arrays
from .selection import order_statistics, powers


def logistic_codebook(spec: DataFrame, levels: int = 9, by: str = "bin", value: str = "v") -> DataFrame:
    """bin, borders, medians: a sigmoid over the range from -|min| to max.

    borders: its values at levels + 1 even steps from -10 to 10 without the first and the last, then the
    maximum; medians: at `levels` even steps from -9.5 to 9.5.
    """
    return logistic_from_ranges(spec.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi")), levels, by)


def logistic_from_ranges(ranges: DataFrame, levels: int = 9, by: str = "bin") -> DataFrame:
    """logistic_codebook() from the least and greatest value, lo and hi, of each bin."""

    def sigmoid(ts: np.ndarray) -> Column:
        scale = F.abs("lo") + F.col("hi")
        return F.transform(F.array(*(F.lit(float(t)) for t in ts)), lambda t: scale / (1 + F.exp(-0.5 * t)) - F.abs("lo"))

    inner = sigmoid(np.linspace(-10, 10, levels + 1)[1:-1])
    return ranges.select(by, F.concat(inner, F.array("hi")).alias("borders"), sigmoid(np.linspace(-9.5, 9.5, levels)).alias("medians"))


def median_cut_codebook(spec: DataFrame, levels: int = 9, by: str = "bin", value: str = "v") -> DataFrame:
    """bin, borders, medians: the longest interval is cut at its median until there are enough.

    An interval of one value is not cut; if all are, the codebook has fewer levels.  Rounds of exact selection find
    the middle values of all bins' intervals together, so no bin's values are gathered; what the driver
    keeps has the size of the codebook.
    """
    kind = spec.schema[by].dataType
    spark, ask = spec.sparkSession, StructType([StructField(by, kind), StructField("k", LongType())])
    first = powers(spec, [by], value)
    plans = {r[0]: Cuts(r[1], levels) for r in first.groupBy(by).agg(F.sum("_n")).collect()}
    while wanted := [(b, k) for b, plan in plans.items() for k in plan.wanted()]:
        for r in order_statistics(spec, [by], value, spark.createDataFrame(wanted, ask), first).collect():
            plans[r[by]].known[r["k"]] = (r["v"], r["less"] + r["equal"])
    rows = [(b, *plan.book()) for b, plan in plans.items()]
    return spark.createDataFrame(rows, StructType([StructField(by, kind), *(StructField(c, ArrayType(DoubleType())) for c in ("borders", "medians"))]))


class Cuts:
    """The intervals of a group of n values, as places in their order, as far as the values at some places are known."""

    def __init__(self, n: int, levels: int):
        self.levels, self.spans, self.whole = levels, [(0, n)], []
        #: By place in the order: the value there, and how many values are not above it.
        self.known: dict[int, tuple[float, int]] = {}

    def wanted(self) -> list[int]:
        """Places whose values tell what comes next; none if the intervals are final."""
        size = lambda s: s[1] - s[0]
        while self.spans and len(self.spans) + len(self.whole) < self.levels:
            self.spans.sort(key=size)  # of equally long ones the last made is cut
            a, b = self.spans[-1]
            if a + (b - a) // 2 not in self.known:
                break
            self.spans.pop()
            cut = self.known[a + (b - a) // 2][1]
            if cut < b:
                self.spans += [(a, cut), (cut, b)]
            else:
                self.whole.append((a, b))
        return sorted({k for a, b in self.spans + self.whole for k in self._places(a, b)} - set(self.known))

    @staticmethod
    def _places(a: int, b: int) -> tuple[int, int, int]:
        return a + (b - a - 1) // 2, a + (b - a) // 2, b - 1

    def book(self) -> tuple[list[float], list[float]]:
        ends = [[self.known[k][0] for k in self._places(a, b)] for a, b in sorted(self.spans + self.whole)]
        return [last for _, _, last in ends], [(low + high) / 2 for low, high, _ in ends]


def level(v: str | Column, borders: str | Column) -> Column:
    """The first level whose border is not below v; 0 for a value above the last border."""
    v = F.col(v) if isinstance(v, str) else v
    borders = F.col(borders) if isinstance(borders, str) else borders
    below = F.size(F.filter(borders, lambda b: b < v)).cast("bigint")
    return F.when(below == F.size(borders), F.lit(0).cast("bigint")).otherwise(below)


def quantised(spec: DataFrame, codebook: DataFrame, by: str = "bin", value: str = "v") -> DataFrame:
    """spec with level; the codebook has a row for each bin."""
    return spec.join(codebook.select(by, "borders"), by).withColumn("level", level(value, "borders")).drop("borders")


def dequantised(levels: DataFrame, codebook: DataFrame, by: str = "bin") -> DataFrame:
    """levels with v, the level's representative."""
    return levels.join(codebook.select(by, "medians"), by).withColumn("v", F.get("medians", F.col("level").cast("int"))).drop("medians")


def smoothed_frames(values: DataFrame, sigma: float = 0.5, *keys: str) -> DataFrame:
    """keys, frame, mel: each frame's values in the order of bins, smoothed across them; a frame has as many values as there are bins."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda s: s["v"])
    return values.groupBy(*keys, "frame").agg(rows.alias("mel")).withColumn("mel", arrays.smoothed("mel", arrays.gaussian(sigma)))


def missing_levels(levels: DataFrame, n: int, by: str = "bin") -> DataFrame:
    """bin and level of each level that no frame of the bin has."""
    seen = levels.select(by, F.col("level").cast("bigint").alias("level")).distinct()
    every = seen.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("level"))
    return every.join(seen, [by, "level"], "left_anti")
