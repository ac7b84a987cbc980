"""Linear discriminant models, one for each target, over shared features.

Fitting needs, besides the sums over all frames, the number of frames and the sum of features of each class of
each target: the scatter within the classes is the total less what the class means explain.  Both come from
one pass each over the frames, in which a task sends no more than these sums.  The driver solves small systems.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .statistics import matrix

MODEL = "bin bigint, classes array<bigint>, coef array<array<double>>, intercept array<double>"


@dataclass
class Model:
    """Of one target: its classes in ascending order, weights (classes x features) and intercepts."""

    classes: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[np.argmax(x @ self.coef.T + self.intercept, axis=1)]


def class_sums(df: DataFrame, x: str, levels: str) -> DataFrame:
    """bin, level, n, at, s: for each target (position in the array of levels) and class, the number of frames and the sum of each feature."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            m, y = matrix(batch.column(0)), matrix(batch.column(1)).astype(np.int64)
            for b in range(y.shape[1]):
                for c in np.unique(y[:, b]):
                    own = m[y[:, b] == c]
                    n, s = sums.get((b, int(c)), (0, 0.0))
                    sums[b, int(c)] = n + len(own), s + own.sum(0)
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].tolist() for k in keys], pa.list_(pa.float64()))], names=["bin", "level", "n", "s"])

    rows = df.select(F.col(x).cast("array<double>"), F.col(levels).cast("array<double>")).where(F.col(x).isNotNull() & F.col(levels).isNotNull()).mapInArrow(scan, "bin bigint, level bigint, n bigint, s array<double>")
    return rows.select("bin", "level", "n", F.posexplode("s").alias("at", "s")).groupBy("bin", "level", F.col("at").cast("bigint").alias("at")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def solve(n: int, s: np.ndarray, g: np.ndarray, classes: np.ndarray, counts: np.ndarray, sums: np.ndarray, tol: float = 1e-4) -> Model:
    """From the total sums and those of the classes.  Directions without scatter within the classes are left out.

    A target with one class is always predicted as that one.
    """
    d = len(s)
    if len(classes) < 2:
        return Model(classes, np.zeros((len(classes), d)), np.zeros(len(classes)))
    mean, means, prior = s / n, sums / counts[:, None], counts / n
    within = g - (means * counts[:, None]).T @ means
    std = np.sqrt(np.maximum(np.diag(within), 0) / n)
    std[std == 0] = 1.0
    values, vectors = np.linalg.eigh(within / max(1, n - len(classes)) / np.outer(std, std))
    some = values > tol**2 * max(values.max(), 1e-300)
    white = (vectors[:, some] / np.sqrt(values[some])) / std[:, None]
    centred = (means - mean) @ white
    coef = centred @ white.T
    return Model(classes, coef, -0.5 * (centred**2).sum(1) + np.log(prior) - coef @ mean)


def fit(df: DataFrame, x: str, levels: str) -> list[Model]:
    """A model for each position of the array of levels; every frame counts."""
    return fit_by(df.withColumn("_key", F.lit(0)), "_key", x, levels).get(0, [])


def fit_by(df: DataFrame, key: str, x: str, levels: str) -> dict[int, list[Model]]:
    """fit() for the frames of each key, a whole number, all in two passes: the mean of all, so that products are of small numbers, then sums.

    A task sends sums for each key, so keys are the folds of an evaluation, not the rows of a table.
    """
    rows = _rows(df, x, levels, F.col(key).cast("bigint"))
    shift = _mean(rows)
    if not len(shift):
        return {}
    cells = _sums(rows, shift).toPandas()
    return {k: _models(part, shift) for k, part in cells.groupby("key")}


def _rows(df: DataFrame, x: str, levels: str, key: Column) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(levels).isNotNull()).select(key.alias("key"), F.col(x).cast("array<double>").alias("x"), F.col(levels).cast("array<double>").alias("y"))


def _mean(rows: DataFrame) -> np.ndarray:
    means = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(means, key=lambda r: r["at"])])


def _sums(rows: DataFrame, shift: np.ndarray) -> DataFrame:
    """key, bin, level, at, n, v: the sums of x less the shift, and of its products, of each key (bin and level -1), and the sums of each class."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}  # (key, target, class); -1 and -1 for the whole
        for batch in batches:
            if not len(batch):
                continue
            keys, m, y = np.asarray(batch.column(0)), matrix(batch.column(1)) - shift, matrix(batch.column(2)).astype(np.int64)
            for p in np.unique(keys).tolist():
                own, classes = m[keys == p], y[keys == p]
                found = [((p, -1, -1), len(own), np.concatenate([own.sum(0), (own.T @ own).ravel()]))]
                found += [((p, b, c), int((classes[:, b] == c).sum()), own[classes[:, b] == c].sum(0)) for b in range(y.shape[1]) for c in np.unique(classes[:, b]).tolist()]
                for at, n, v in found:
                    before = sums.get(at, (0, 0.0))
                    sums[at] = before[0] + n, before[1] + v
        if sums:
            columns = [pa.array([at[k] for at in sums], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([v.tolist() for _, v in sums.values()], pa.list_(pa.float64()))], names=["key", "bin", "level", "n", "v"])

    parts = rows.mapInArrow(scan, "key bigint, bin bigint, level bigint, n bigint, v array<double>")
    return parts.select("key", "bin", "level", "n", F.posexplode("v").alias("at", "v")).groupBy("key", "bin", "level", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def _models(cells: pd.DataFrame, shift: np.ndarray) -> list[Model]:
    """From the sums of one key."""
    d = len(shift)
    totals: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for at, part in cells.groupby(["bin", "level"]):
        totals[at] = int(part["n"].iloc[0]), part.sort_values("at")["v"].to_numpy()
    n, flat = totals[-1, -1]
    out = []
    for b in sorted({at[0] for at in totals if at[0] >= 0}):
        own = sorted((at[1], *totals[at]) for at in totals if at[0] == b)
        m = solve(n, flat[:d], flat[d:].reshape(d, d), np.array([c for c, *_ in own]), np.array([k for _, k, _ in own], dtype=float), np.array([v for *_, v in own]))
        out.append(Model(m.classes, m.coef, m.intercept - m.coef @ shift))
    return out


def store_sums(df: DataFrame, path: str, recording: str, x: str, levels: str) -> None:
    """Put the sums of a recording beside those of others below path; a recording that is there already is replaced.

    levels are by a codebook that all recordings share.  The first recording's mean is the shift of all sums, which
    makes products small; it is stored, so that later ones use it too.
    """
    spark, rows = df.sparkSession, _rows(df, x, levels, F.lit(0).cast("bigint"))
    try:
        shift = _shift(spark, path)
    except AnalysisException:  # nothing is there yet
        shift = _mean(rows)
        if not len(shift):
            return
        spark.createDataFrame([(shift.tolist(),)], "shift array<double>").coalesce(1).write.mode("ignore").parquet(f"{path}/shift")
        shift = _shift(spark, path)
    _sums(rows, shift).drop("key").write.mode("overwrite").parquet(f"{path}/sums/recording={recording}")


def _shift(spark: SparkSession, path: str) -> np.ndarray:
    return np.array(spark.read.parquet(f"{path}/shift").first()["shift"])


def fit_stored(spark: SparkSession, path: str, recordings: Sequence[str] | None = None) -> list[Model]:
    """fit() of all frames of the stored recordings, or of some of them, from their sums alone."""
    cells = spark.read.parquet(f"{path}/sums")
    if recordings is not None:
        cells = cells.where(F.col("recording").cast("string").isin(list(recordings)))
    cells = cells.groupBy("bin", "level", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()  # a matrix's size
    return _models(cells, _shift(spark, path)) if len(cells) else []


def predicted(df: DataFrame, x: str, models: list[Model] | dict[int, list[Model]], key: str | None = None) -> DataFrame:
    """df with predicted, the array of the targets' classes; the models, those of the row's key if there is one, are small and go to every task."""
    sent = df.sparkSession.sparkContext.broadcast({0: models} if key is None else models)
    fields = list(df.schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(x))
            keys = np.zeros(len(m), dtype=np.int64) if key is None else np.asarray(batch.column(key))
            out: list[list[int]] = [[]] * len(m)
            for p in np.unique(keys).tolist():
                rows = np.flatnonzero(keys == p)
                for k, found in zip(rows, zip(*(model.predict(m[rows]).tolist() for model in sent.value.get(p, [])), strict=True), strict=False):
                    out[k] = list(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "predicted"])

    return df.mapInArrow(scan, StructType([*fields, *StructType.fromDDL("predicted array<bigint>")]))


def table(spark: SparkSession, models: list[Model]) -> DataFrame:
    """Models as rows, to be stored as any table."""
    rows = [(b, m.classes.tolist(), m.coef.tolist(), m.intercept.tolist()) for b, m in enumerate(models)]
    return spark.createDataFrame(rows, MODEL)


def from_table(df: DataFrame) -> list[Model]:
    return [Model(np.array(r["classes"]), np.array(r["coef"]), np.array(r["intercept"])) for r in df.orderBy("bin").collect()]


def activations(models: list[Model], cov: np.ndarray) -> np.ndarray:
    """Per feature the mean over classes and targets of |cov W inv(W' cov W)|.

    The patterns behind the weights; a pseudo-inverse serves where classes depend on each other.  Targets with
    fewer classes than the most have zeros for those that they lack.
    """
    most = max((len(m.classes) for m in models), default=0)
    total = np.zeros(len(cov))
    for m in models:
        w = m.coef.T
        pattern = cov @ w @ np.linalg.pinv(w.T @ cov @ w)
        total += np.abs(pattern).sum(1)
    return total / max(1, most * len(models))


def activation_rows(spark: SparkSession, found: np.ndarray, selected: Sequence[str], channels: Sequence[str], lags: int = 5) -> DataFrame:
    """channel, lag, activation: activations() of the selected features, which are named channel-lag, on the grid of all channels and lags; features that were not selected have 0."""
    grid = {(c, k): 0.0 for c in channels for k in range(lags)}
    for name, a in zip(selected, found, strict=True):
        channel, _, lag = name.rpartition("-")
        grid[channel, int(lag)] = float(a)
    return spark.createDataFrame([(c, k, a) for (c, k), a in grid.items()], "channel string, lag int, activation double")
