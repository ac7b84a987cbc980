"""Logistic regression by FTRL-proximal over hashed word n-grams, trained in shards and scored in place.

Features are whether a text has a word, a pair of neighbouring words or a pair with one word between
(a skip-gram), each hashed to one of 2^BITS coordinates.  Every coordinate has its own learning rate, and the
L1 term keeps those at zero that do not earn a weight, so the weights are compact and of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import small_batches, written
from .textbytes import ALNUM, combine, mix, slices, words

BITS = 18
SKIP = np.uint64(0x5851F42D4C957F2D)
SLICE = 1 << 20


#: (row, coordinate, value) of the features of the rows of a slice; of repeats without values one counts, values add up.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def word_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    h, _, first = words(data, offsets, ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, hashes = [row], [mix(h)]
    for gap in (1, 2):
        if len(h) > gap:
            inside = row[:-gap] == row[gap:]
            rows.append(row[:-gap][inside])
            both = combine(h[:-gap], h[gap:])[inside]
            hashes.append(mix(both ^ SKIP) if gap == 2 else both)
    return np.concatenate(rows), coordinate(np.concatenate(hashes)), None


def coordinate(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Ftrl:
    """State z and n of FTRL-proximal; the last coordinate is the intercept, which L1 spares."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, l1 = self.z[at], np.full(len(self.z[at]), self.l1)
        if len(l1):
            l1[-1] = 0.0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, target: float) -> None:
        """One step; at: the row's coordinates with the intercept last, x: their values, target: its label, or posterior."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - target) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def prepared(texts: list[str | None], features: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its coordinates, the intercept's last, and their values; texts are taken some at a time."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    raw = [(t or "").encode() for t in texts]
    size = np.cumsum([0, *map(len, raw)])
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + SLICE, side="right")) - 1)
        row, at, x = features(np.frombuffer(b"".join(raw[lo:hi]), dtype=np.uint8), size[lo : hi + 1] - size[lo])
        both, inverse = np.unique(row << BITS | at, return_inverse=True)
        x = np.ones(len(both)) if x is None else np.bincount(inverse, weights=x, minlength=len(both))
        ends = np.searchsorted(both >> BITS, np.arange(hi - lo + 1))
        at = both & ((1 << BITS) - 1)
        out += [(np.append(at[a:b], 1 << BITS), np.append(x[a:b], 1.0)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        lo = hi
    return out


def _shard(rates: tuple, sent, epochs: range, features: Features):
    def learn(part: pd.DataFrame) -> pd.DataFrame:
        own = Ftrl(*rates, sent.value[0].copy(), sent.value[1].copy())
        part = part.sort_values("doc_id", kind="stable")
        rows, target = prepared(part["text"].to_list(), features), part["target"].to_numpy()
        for epoch in epochs:
            for i in np.random.default_rng(epoch).permutation(len(part)):
                own.learn(*rows[i], target[i])
        return pd.DataFrame({"z": [own.z.tobytes()], "n": [own.n.tobytes()]})

    return learn


def train(rows: DataFrame, ftrl: Ftrl, shards: int = 4, rounds: int = 3, epochs: int = 2, features: Features = word_ngrams) -> np.ndarray:
    """Weights from rows (doc_id, text, target); the rows are a sample that the caller has bounded.

    Each round is a job: every shard goes on from the same state over its rows for some epochs, in an order
    that depends on the epoch, and the shards' states are averaged.  A state has 2^BITS + 1 coordinates.
    """
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    sample = written(rows.select(shard, F.col("doc_id").cast("long"), F.col("target").cast("double"), F.col("text").cast("string").alias("text")), "sample")
    rates = (ftrl.alpha, ftrl.beta, ftrl.l1, ftrl.l2)
    for k in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast((ftrl.z, ftrl.n))
        learn = _shard(rates, sent, range(k * epochs, (k + 1) * epochs), features)
        states = sample.groupBy("shard").applyInPandas(learn, "z binary, n binary").collect()
        if states:
            ftrl.z = np.mean([np.frombuffer(s["z"]) for s in states], axis=0)
            ftrl.n = np.mean([np.frombuffer(s["n"]) for s in states], axis=0)
        sent.unpersist()
    return ftrl.weights().astype(np.float32)


def scored(documents: DataFrame, weights: np.ndarray, *keep: str, features: Features = word_ngrams) -> DataFrame:
    """The columns to keep and score, the probability of a 1; a null or empty text has the intercept's."""
    sent = documents.sparkSession.sparkContext.broadcast(weights)
    fields = [f for f in documents.schema if f.name in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "_text", SLICE):
                row, at, x = features(data, offsets)
                some = w[at] != 0
                pair, inverse = np.unique(row[some] << BITS | at[some], return_inverse=True)
                x = 1.0 if x is None else np.bincount(inverse, weights=x[some], minlength=len(pair))
                logit = w[-1] + np.bincount(pair >> BITS, weights=w[pair & ((1 << BITS) - 1)] * x, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(lo, hi - lo) for f in fields), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], names=[*(f.name for f in fields), "score"])

    text = F.col("text").cast("string").alias("_text")
    return small_batches(documents.select(*(f.name for f in fields), text)).mapInArrow(scan, StructType([*fields, *StructType.fromDDL("score double")]))


def smallest(df: DataFrame, key: str, most: int, n: int) -> DataFrame:
    """Of the n rows those with the smallest hashes of key, `most` of them: the same rows however df is partitioned.

    A threshold on the hash leaves few more before the order is looked at; rows alike in key are taken together or not.
    """
    share = min(1.0, 1.2 * most / max(1, n) + 1e-4)
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    return df.where(hashed < F.lit(int(share * (1 << 40)) + 1)).orderBy(hashed, key).limit(most)
