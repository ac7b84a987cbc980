"""Joins through time of two streams: samples in trials, and the sample nearest to each marker.

Both sides have a watermark.  Rows wait in Spark's state until nothing that they could meet can come any more, so
markers may be late, or early, by up to the delay; what is later than that is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_trials(samples: DataFrame, markers: DataFrame, seconds: float = 2.0, prefix: str = "start;", delay: str = "10 seconds", by: str = "stream") -> DataFrame:
    """The samples (stream, ts, ...) within `seconds` after a marker (stream, ts, label) that begins a trial, with begin and word; the end is not part of it.

    A sample in several trials has a row for each.
    """
    begins = markers.where(F.col("label").startswith(prefix)).select(F.col(by).alias("_by"), F.col("ts").alias("begin"), F.trim(F.expr(f"substring(label, {len(prefix) + 1})")).alias("word"))
    span = F.expr(f"interval '{seconds!r}' second")
    within = (F.col(by) == F.col("_by")) & (F.col("ts") >= F.col("begin")) & (F.col("ts") < F.col("begin") + span)
    return samples.withWatermark("ts", delay).join(begins.withWatermark("begin", delay), within).drop("_by")


def nearest(markers: DataFrame, samples: DataFrame, value: str, seconds: float = 1.0, delay: str = "10 seconds", by: str = "stream") -> DataFrame:
    """stream, at, label and, of the sample (stream, ts, value) that is nearest to the marker (stream, ts, label), its ts and value: of equally near ones the earlier.

    Looked at is what is within `seconds`; a marker comes out once the watermark has passed it, and without samples near it never.
    Markers alike in stream, time and label are one.
    """
    span = F.expr(f"interval '{seconds!r}' second")
    m = markers.select(F.col(by).alias("_by"), F.col("ts").alias("at"), "label").withWatermark("at", delay)
    s = samples.select(by, "ts", F.col(value).alias("value")).withWatermark("ts", delay)
    near = s.join(m, (F.col(by) == F.col("_by")) & (F.col("ts") >= F.col("at") - span) & (F.col("ts") <= F.col("at") + span))
    apart = F.abs(F.unix_micros("ts") - F.unix_micros("at"))
    found = near.groupBy(by, "at", "label").agg(F.min(F.struct(apart.alias("apart"), "ts", "value")).alias("hit"))
    return found.select(by, "at", "label", "hit.ts", "hit.value")
