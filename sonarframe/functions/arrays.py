"""Expressions on arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: str | Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: str | Column) -> Column:
    """Null for an empty array."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(total(x), F.size(x))


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values)).cast("array<double>")


def sparse_product(x: str | Column, rows: Sequence[Sequence[float]]) -> Column:
    """The product of a matrix, given by rows, with the vector x; of each row only the stretch from its first to its last entry is used."""
    x = F.col(x) if isinstance(x, str) else x
    stretches = []
    for row in rows:
        some = [k for k, w in enumerate(row) if w]
        first, end = (some[0], some[-1] + 1) if some else (0, 0)
        stretches.append(F.struct(F.lit(first + 1).alias("first"), vector(row[first:end]).alias("w")))
    return F.transform(F.array(*stretches), lambda m: dot(F.slice(x, m["first"], F.size(m["w"])), m["w"]))


def one_hot(level: str | Column, n: int) -> Column:
    """n numbers, 1.0 at the level and 0.0 elsewhere."""
    level = F.col(level) if isinstance(level, str) else level
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == level).cast("double"))


def dct2(x: str | Column, n: int, keep: int) -> Column:
    """The first coefficients of the unnormalised DCT-II of n numbers: 2 * sum x_j cos(pi k (2 j + 1) / (2 n))."""
    import math

    return F.array(*(2 * dot(x, vector([math.cos(math.pi * k * (2 * j + 1) / (2 * n)) for j in range(n)])) for k in range(keep)))


def smoothed(x: str | Column, kernel: Sequence[float]) -> Column:
    """Correlation with a kernel of odd length; at the edges the numbers are mirrored, the edge ones repeated."""
    x = F.col(x) if isinstance(x, str) else x
    half = len(kernel) // 2
    n = F.size(x)

    def at(i: Column) -> Column:  # half is less than n
        i = F.when(i < 0, -i - 1).otherwise(i)
        return F.get(x, F.when(i >= n, 2 * n - 1 - i).otherwise(i))

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((at(i + (k - half)) * w for k, w in enumerate(kernel)), F.lit(0.0)))


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Taps of a Gaussian out to truncate * sigma, to the nearest whole number, with the sum 1."""
    import math

    radius = int(truncate * sigma + 0.5)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [t / sum(taps) for t in taps]
