"""The mel filter bank: triangles on the bins of a spectrum."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import sparse_product

#: Added before the logarithm.
FUZZ = 1e-7


def edges(bins: int, filters: int, sr: float) -> list[int]:
    """Bins at which the triangles begin, peak and end: evenly spaced on the mel scale, whole Hertz."""
    top = 2595.0 * math.log10(1.0 + sr / 2 / 700.0)
    hertz = (math.floor(700.0 * (math.pow(10.0, i * (top / (filters + 1)) / 2595.0) - 1.0)) for i in range(filters + 2))
    return [int(math.floor(h / (sr / 2) * bins)) for h in hertz]


def matrix(bins: int, filters: int, sr: float) -> np.ndarray:
    """filters x bins; each filter's weights have the sum 1, or are all 0."""
    e, k = edges(bins, filters, sr), np.arange(bins)
    out = np.zeros((filters, bins))
    for i, (a, b, c) in enumerate(zip(e, e[1:], e[2:], strict=False)):
        out[i] = np.where((k >= a) & (k < b), (k - a) / max(b - a, 1), np.where((k >= b) & (k < c), (c - k) / max(c - b, 1), 0.0))
    return normalised(out)


def inverse(bins: int, filters: int, sr: float) -> np.ndarray:
    """bins x filters: the transpose with the sum 1 for each bin, or 0."""
    return normalised(matrix(bins, filters, sr).T)


def normalised(m: np.ndarray) -> np.ndarray:
    s = m.sum(1, keepdims=True)
    return m / np.where(s == 0, 1.0, s)


def finite(x: Column) -> Column:
    """0 for what is not a finite number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def to_log_mels(spectrum: str | Column, m: np.ndarray) -> Column:
    return F.transform(sparse_product(spectrum, m.tolist()), lambda v: finite(F.log(v + FUZZ)))


def from_log_mels(log_mels: str | Column, inv: np.ndarray) -> Column:
    return F.transform(sparse_product(F.transform(log_mels, lambda v: F.exp(v)), inv.tolist()), finite)
