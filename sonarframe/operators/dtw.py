"""Dynamic time warping of pairs of sequences of equal length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


#: Anti-diagonals whose steps are kept at once, and places at which a stretch of more is taken up again.
LEAF, FAN = 512, 16


class _Costs:
    """The costs of two anti-diagonals next to each other, by query position from `first` on: what the next ones follow from."""

    def __init__(self, d: int, first: int, before: np.ndarray, last: np.ndarray):
        self.d, self.first, self.before, self.last = d, first, before, last

    def part(self, lo: int, hi: int) -> _Costs:
        """Those of the positions from lo to hi."""
        return _Costs(self.d, lo, self.before[lo - self.first : hi + 1 - self.first], self.last[lo - self.first : hi + 1 - self.first])

    def sweep(self, query: np.ndarray, reference: np.ndarray, end: int, marks: set[int] | None = None) -> tuple[np.ndarray | None, list[_Costs]]:
        """(the step that led to each cell of each anti-diagonal up to end; none with marks, the costs at which are the second)."""
        before, last, first = self.before, self.last, self.first
        hi = first + len(last) - 1
        steps = None if marks else np.zeros((end - self.d, len(last)), dtype=np.uint8)
        kept, edge = [], np.full(len(last), np.inf)
        for d in range(self.d + 1, end + 1):
            i = np.arange(max(1, first, d - len(reference)), min(len(query), d - 1, hi) + 1)
            new = edge.copy()
            if len(i):
                own, left = i - first, i - 1 - first
                inside = left >= 0  # what is further to the left does not lead to where the way ends
                ways = np.stack([np.where(inside, before[left], np.inf), np.where(inside, last[left], np.inf), last[own]])  # from (i - 1, j - 1), (i - 1, j) and (i, j - 1)
                best = ways.argmin(0)
                new[own] = ways[best, np.arange(len(i))] + np.sqrt(((query[i - 1] - reference[d - i - 1]) ** 2).sum(1))
                if steps is not None:
                    steps[d - self.d - 1, own] = best
            before, last = last, new
            if marks and d in marks:
                kept.append(_Costs(d, first, before, last))
        return steps, kept


def path(query: np.ndarray, reference: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> list[tuple[int, int]]:
    """The cheapest alignment under Euclidean distances, exact; of equal ones a diagonal step is taken, then one of the query.

    Costs are made along anti-diagonals, each of which is one array operation on the two before it.  The way back needs
    the steps that led to its cells, which for all cells would be n * m bytes; so costs are kept at a few
    anti-diagonals, and from the last of them the steps are made again for what leads to the end alone: what is d
    anti-diagonals before it spans d positions.  Stretches that are still long are divided in the same way.
    Memory is some dozens of numbers for each frame, and time is little more than that of one sweep.
    """
    n, m = len(query), len(reference)
    out: list[tuple[int, int]] = []
    start = np.full(n + 1, np.inf)
    start[0] = 0.0

    def back(costs: _Costs, i: int, d: int) -> tuple[int, int]:
        """The way from cell i of anti-diagonal d back to the costs' own, or past it."""
        long = d - costs.d
        costs = costs.part(max(costs.first, i - long, 0), i)
        if long > leaf:
            step = -(-long // fan)
            _, kept = costs.sweep(query, reference, d - 1, set(range(costs.d + step, d, step)))
            for mark in [*kept[::-1], costs]:
                while d > mark.d and 0 < i < d:
                    i, d = back(mark, i, d)
            return i, d
        steps, _ = costs.sweep(query, reference, d)
        while d > costs.d and 0 < i < d:
            out.append((i - 1, d - i - 1))
            k = steps[d - costs.d - 1, i - costs.first]
            i, d = i - (k != 2), d - 1 - (k == 0)
        return i, d

    if n and m:
        back(_Costs(1, 0, start, np.full(n + 1, np.inf)), n, n + m)
    return out[::-1]


def warping(steps: list[tuple[int, int]], n: int) -> np.ndarray:
    """For each query position one of the reference: the last that it is matched with, but the first for position 0."""
    index = np.zeros(n, dtype=np.int64)
    for q, r in steps:
        index[q] = max(index[q], r)
    if n:
        index[0] = 0
    return index


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the columns of Pearson's r; columns that do not vary are left out, NaN if none is left."""
    a, b = a - a.mean(0), b - b.mean(0)
    spread = np.sqrt((a**2).sum(0) * (b**2).sum(0))
    some = spread > 1e-12
    return float(((a * b).sum(0)[some] / spread[some]).mean()) if some.any() else float("nan")


def warped_correlation(pairs: DataFrame, *by: str) -> DataFrame:
    """by (pair, if no columns are named) and r from rows (by, side 0 query or 1 reference, frame, mel): the reference warped to the query, then correlated.

    A pair is one utterance long on each side, and each pair is a group of its own.  Sides of unequal length
    are cut to the shorter one; a pair without frames on both has NaN.
    """
    by = by or ("pair",)
    kinds = ", ".join(f"{c} {dict(pairs.dtypes)[c]}" for c in by)

    def score(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        q, r = (np.array(part.loc[part["side"] == s, "mel"].to_list(), dtype=float) for s in (0, 1))
        n = min(len(q), len(r))
        value = correlation(r[:n][warping(path(q[:n], r[:n]), n)], q[:n]) if n > 1 else float("nan")
        return pd.DataFrame({**{c: part[c].iloc[:1].to_list() for c in by}, "r": [value]})

    return pairs.select(*by, "side", "frame", "mel").groupBy(*by).applyInPandas(score, f"{kinds}, r double")
