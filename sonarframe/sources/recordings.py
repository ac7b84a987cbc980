"""Recordings by their format: canonical Parquet, XDF, WAV and HDF5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import sized
from . import hdf5, wav, xdf


def _format(path: str) -> str:
    name = path.lower().rstrip("/")
    for kind, endings in {"xdf": (".xdf", ".xdfz", ".xdf.gz"), "wav": (".wav",), "hdf5": (".hdf", ".h5", ".hdf5"), "parquet": (".parquet",)}.items():
        if name.endswith(endings):
            return kind
    raise ValueError(f"no reader for {path}")


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a recording; what they look like depends on the format that the path's ending names.  signals() has one schema for all."""
    readers = {"xdf": xdf.read, "wav": wav.read, "hdf5": read_hdf5, "parquet": lambda s, p: s.read.parquet(p)}
    return readers[_format(path)](spark, path)


def signals(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, kind ("sEEG" or "Audio"), sr, idx and x of recordings in any format; those of XDF between the experiment's markers, with what xdf.recording() takes."""
    kind = _format(path)
    if kind == "xdf":
        rows, _ = xdf.recording(spark, path, **options)
        kinds = options.get("kinds") or xdf.STREAMS
        heads = xdf.streams(xdf.read(spark, path, names=list(kinds.values()), kinds=("header",)))
        kind_of = F.create_map(*(F.lit(v) for pair in kinds.items() for v in pair[::-1]))
        rates = heads.select("path", kind_of[F.col("name")].alias("kind"), F.col("srate").cast("int").alias("sr"))
        return rows.join(sized(rates), ["path", "kind"]).select("path", "kind", "sr", "idx", "x")
    if kind == "wav":
        return wav.read(spark, path).select("path", F.lit("Audio").alias("kind"), "sr", "idx", F.array(F.col("v").cast("double")).alias("x"))
    return read_signal(spark, path).select("path", "kind", "sr", "idx", "x")


def markers(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, idx, t (null where the format keeps none) and label of the markers of XDF and HDF5 recordings."""
    if _format(path) == "xdf":
        return xdf.recording(spark, path, **options)[1]
    return hdf5.read(spark, path, ["markers"]).select("path", "idx", F.lit(None).cast("double").alias("t"), F.get("texts", F.lit(0)).alias("label"))


def channels(spark: SparkSession, path: str) -> DataFrame:
    """path, ch and name of the neural channels of XDF and HDF5 recordings, ch_000 and so on where a file names none."""
    if _format(path) == "xdf":
        rows = xdf.read(spark, path, names=[xdf.STREAMS["sEEG"]], kinds=("header",))
        counts, found = xdf.streams(rows).select("path", F.col("channels").alias("n")), xdf.labels(rows).select("path", "ch", "name")
    else:
        found = hdf5.read(spark, path, ["ch_names"]).select("path", F.col("idx").cast("int").alias("ch"), F.get("texts", F.lit(0)).alias("name"))
        counts = hdf5.read(spark, path, ["sEEG"]).where("idx = 0").select("path", F.size("x").alias("n"))
    every = counts.select("path", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ch"))
    return every.join(found, ["path", "ch"], "left").select("path", "ch", F.coalesce("name", F.format_string("ch_%03d", "ch")).alias("name"))


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """path, kind ("sEEG" or "Audio"), sr, idx, x of the datasets that a session's file has; a kind without a rate has no rows."""
    rates = hdf5.read(spark, path, ["sEEG_sr", "Audio_sr"]).select("path", F.regexp_replace("name", "_sr$", "").alias("kind"), F.get("x", F.lit(0)).cast("int").alias("sr"))
    rows = hdf5.read(spark, path, ["sEEG", "Audio"]).select("path", F.col("name").alias("kind"), "idx", "x")
    return rows.join(sized(rates), ["path", "kind"]).select("path", "kind", "sr", "idx", "x")


def long(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, ch, idx, v from wide rows of x."""
    return rows.select(*keys, "idx", F.posexplode("x").alias("ch", "v")).select(*keys, "ch", "idx", "v")


def channel_names(n: int, names: list[str] | None = None) -> list[str]:
    """The names of a recording's channels, or ch_000 and so on."""
    return list(names) if names else [f"ch_{k:03d}" for k in range(n)]


def without_channels(rows: DataFrame, bad: list[int]) -> DataFrame:
    """Wide rows without the elements at these positions."""
    return rows.withColumn("x", F.filter("x", lambda _, i: ~i.isin(list(bad)) if bad else F.lit(True)))
