"""Audio: rescaling, spectra, voice activity from waves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import arrays, mel
from . import frames


def rescaled(df: DataFrame, integer: bool, value: str = "v") -> DataFrame:
    """Samples brought to -1 to 1: whole-number recordings by 2^15, and again while they are above 1, then below -1."""
    x = F.col(value).cast("double") / (2**15 if integer else 1)
    df = df.withColumn(value, x)
    lo, hi = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    for outside in (lambda a, b: b is not None and b > 1, lambda a, b: a is not None and a < -1):
        if outside(lo, hi):
            df = df.withColumn(value, F.col(value) / 2**15)
            lo, hi = lo / 2**15, hi / 2**15
    return df


def with_noise(df: DataFrame, sigma: float = 1e-4, seed: int = 0, value: str = "v") -> DataFrame:
    """Gaussian noise on every sample; it depends on the seed and on how the rows are laid out."""
    return df.withColumn(value, F.col(value) + F.randn(seed) * sigma)


def windows(samples: DataFrame, size: int, shift: int, by: str = "stream", lead: int = 0, partial: bool = True) -> DataFrame:
    """stream, frame, x: arrays of `size` samples, frame k from sample k * shift - lead; samples before the first are 0.

    All full windows; without partial the last possible one is left out.
    """
    last = samples.groupBy(by).agg((F.max("idx") + 1).alias("_n"))
    moved = F.col("idx") + lead
    low = F.greatest(F.floor((moved - size) / shift) + 1, F.lit(0))
    spread = samples.withColumn("frame", F.explode(F.sequence(low, F.floor(moved / shift)))).withColumn("_at", moved - F.col("frame") * shift)
    rows = spread.groupBy(by, "frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_at").cast("int"), "v"))).alias("_m")).join(last, by)
    full = F.col("frame") * shift + size <= F.col("_n") + lead if partial else F.col("frame") * shift + size < F.col("_n") + lead
    x = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return rows.where(full).select(by, "frame", x.alias("x"))


def magnitudes(windowed: DataFrame, column: str = "x", scale: float = 1.0) -> DataFrame:
    """Adds magnitude: absolute values of the real Fourier transform of the column under a symmetric Hann window; one Arrow batch at a time."""
    fields = [f for f in windowed.schema if f.name != column]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(column)
            flat, off = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            spectra = [np.abs(np.fft.rfft(flat[a:b] * np.hanning(b - a) * scale)) if b > a else np.zeros(0) for a, b in zip(off - off[0], off[1:] - off[0], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array([s.tolist() for s in spectra], pa.list_(pa.float64()))], names=[*(f.name for f in fields), "magnitude"])

    return windowed.mapInArrow(scan, StructType([*fields, *StructType.fromDDL("magnitude array<double>")]))


def log_mels(samples: DataFrame, sr: float = 16000, length: float = 0.05, shift: float = 0.01, mels: int = 40, by: str = "stream") -> DataFrame:
    """stream, frame, mel: log-mel spectra; zeros stand before the first sample, so that the first window ends a shift into the signal."""
    size, step = int(sr * length), int(sr * shift)
    spectra = magnitudes(windows(samples, size, step, by, lead=size - step))
    return spectra.select(by, "frame", mel.to_log_mels("magnitude", mel.matrix(size // 2 + 1, mels, sr)).alias("mel"))


def voice_energy(log_mel: str | Column, bins: int) -> Column:
    """The first coefficient of the DCT of log-mels."""
    return F.get(arrays.dct2(log_mel, bins, 1), F.lit(0))


def voiced_from_log_mels(df: DataFrame, bins: int = 40, by: str = "stream", context: int = 5, share: float = 0.6, threshold: float = 4.0, scale: float = 1.0, column: str = "mel") -> DataFrame:
    """Adds energy, hot and voiced."""
    if context < 0 or not 0 < share < 1 or scale < 0:
        raise ValueError("context and scale must not be negative, and share lies between 0 and 1")
    return frames.voiced(df.withColumn("energy", voice_energy(column, bins)), "energy", context, share, threshold, scale, by)


def voiced_from_mfccs(df: DataFrame, by: str = "stream", context: int = 5, share: float = 0.6, threshold: float = 4.0, scale: float = 1.0, column: str = "mfcc") -> DataFrame:
    """Adds energy, hot and voiced from cepstral coefficients, of which the first is the energy."""
    return frames.voiced(df.withColumn("energy", F.get(F.col(column), F.lit(0))), "energy", context, share, threshold, scale, by)


def voiced_from_wave(samples: DataFrame, sr: float = 16000, by: str = "stream", **options) -> DataFrame:
    """stream, frame, mel, energy, hot, voiced of a 16-bit recording: windows of 50 ms every 10 ms."""
    size, step = int(sr * 0.05), int(sr * 0.01)
    spectra = magnitudes(windows(samples, size, step, by, partial=False), scale=2.0**-15)
    mels = spectra.select(by, "frame", mel.to_log_mels("magnitude", mel.matrix(size // 2 + 1, 40, sr)).alias("mel"))
    return voiced_from_log_mels(mels, 40, by, **options)
