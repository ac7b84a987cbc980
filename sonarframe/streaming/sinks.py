"""Callables as sinks of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def to_callback(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that hands each micro-batch, as a DataFrame, and its number to a callable.

    A batch can come again with the same number after a failure, so what the callable writes should depend on it.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
