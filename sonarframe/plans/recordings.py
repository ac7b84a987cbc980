"""Queries on recordings: the events as containers of their own, which Spark writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import folder
from ..sources import xdf
from ..sources.views import signal
from .registry import SIGNAL, query
from .signals import SECONDS, SR, seconds

#: Recordings that the streams are dealt to, and samples for each stamp.
RECORDINGS, STAMPED = 4, 4


def containers(spark: SparkSession, sf_dir: str) -> str:
    """Where the events are, as recordings of several streams with a stamp at each fourth sample."""
    s = signal(spark, sf_dir)
    recording = F.concat(F.lit("r"), F.col("stream") % RECORDINGS)
    samples = s.select(recording.alias("recording"), "stream", "idx", F.when(F.col("idx") % STAMPED == 0, seconds()).alias("t"), F.array("v").alias("x"))
    xml = F.replace(F.lit(xdf.header("user STREAM", "EEG", 1, SR)), F.lit("STREAM"), F.col("stream").cast("string"))
    heads = s.select(recording.alias("recording"), "stream").distinct().withColumn("xml", xml)
    path = f"{folder(spark)}/containers-{uuid.uuid4().hex}"
    xdf.write(xdf.packed(samples, heads), path)
    return path


@query(f"""WITH {SIGNAL}, known AS (SELECT stream, idx, {SECONDS} AS t FROM signal WHERE idx % {STAMPED} = 0)
SELECT s.stream, s.idx, k.t + (s.idx - k.idx) * (1 / {SR}::DOUBLE) AS t, s.v FROM signal s JOIN known k ON k.stream = s.stream AND k.idx = s.idx - s.idx % {STAMPED}""")
def xdf_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of all streams, whose missing stamps follow from the last one and the rate."""
    rows = xdf.read(spark, containers(spark, sf_dir), kinds=("sample",), files="part-*")
    return xdf.signals(rows).select("stream", "idx", "t", F.get("x", F.lit(0)).alias("v"))


@query(f"WITH {SIGNAL} SELECT stream, idx, v FROM signal WHERE stream IN (3, 4, 8)")
def xdf_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three streams by name; chunks of the others are not decoded."""
    rows = xdf.read(spark, containers(spark, sf_dir), names=["user 3", "user 4", "user 8"], kinds=("sample",), files="part-*")
    return xdf.signals(rows).select("stream", "idx", F.get("x", F.lit(0)).alias("v"))


@query(f"SELECT DISTINCT user_id AS stream, 'user ' || user_id AS name, 'EEG' AS type, 1 AS channels, {SR}::DOUBLE AS srate, 'double64' AS format FROM events")
def xdf_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers say of each stream; no sample is decoded."""
    rows = xdf.read(spark, containers(spark, sf_dir), kinds=("header",), files="part-*")
    return xdf.streams(rows).select("stream", "name", "type", "channels", "srate", "format")
