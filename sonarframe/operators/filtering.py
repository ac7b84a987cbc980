"""Causal filtering of numbered samples, in chunks that many tasks share.

A filter, or a cascade of them, is a linear state machine.  Every chunk of a stream is first run from a state of
zeros, which gives the state that its own samples leave behind; these few numbers for each chunk are put together
along the stream (state after = transition * state before + own), and a second pass runs each chunk from its
true state.  So one stream, however long, is not in one task, and only states meet.  A task runs all its chunks
side by side, as columns of one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import filters
from ..functions.groups import numbers, whole

CHUNK = 1 << 14

#: Filters that follow each other, each with its start: "rest" from zeros, "cold" as if its first sample had always been there, "warm" from the steady state of a 1 followed by a number of zeros.
Stages = Sequence[tuple[filters.Sections, str]]


def _run(stages: Stages, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, state) of samples (time x columns) and the states of all stages (numbers x columns)."""
    ends, at = [], 0
    for sections, _ in stages:
        size = 2 * len(sections)
        x, end = filters.run(sections, x, state[at : at + size].reshape(len(sections), 2, -1))
        ends.append(end.reshape(size, -1))
        at += size
    return x, np.concatenate(ends)


def _begin(stages: Stages, zeros: int, heads: np.ndarray) -> np.ndarray:
    """The state of all stages (numbers x streams) before the first samples of streams."""
    out, x = [], heads[None, :]
    for sections, start in stages:
        if start == "cold":
            state = filters.cold(sections, x[0])
        else:
            state = filters.warm(sections, 1, zeros) if start == "warm" else np.zeros((len(sections), 2, 1))
            state = np.repeat(state, len(heads), axis=2)
        out.append(state.reshape(2 * len(sections), -1))
        x, _ = filters.run(sections, x, state)
    return np.concatenate(out)


def _vectors(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of doubles, all of this width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _arrays(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _columns(x: np.ndarray, begin: np.ndarray, size: np.ndarray, of: np.ndarray, height: int) -> np.ndarray:
    """The groups `of` as columns, zeros below the shorter ones."""
    at = begin[of] + np.arange(height)[:, None]
    return np.where(np.arange(height)[:, None] < size[of], x[np.minimum(at, len(x) - 1)], 0.0)


def cascade(df: DataFrame, stages: Stages, by: str = "stream", zeros: int = 0, chunk: int = CHUNK) -> DataFrame:
    """df (by, idx, v, others) with v run through the stages; idx is numbered from 0 without gaps.

    The order of rows does not matter.  Null samples count as 0.
    """
    marked = df.withColumn("_chunk", F.floor(F.col("idx") / chunk).cast("bigint"))
    of_stream = df.schema[by].dataType.simpleString()
    n_states = sum(2 * len(s) for s, _ in stages)
    keys, columns = [by, "_chunk"], df.columns

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each full chunk leaves behind; nothing comes after one that is not full."""
        for table, begin in whole(batches, keys):
            x = np.nan_to_num(numbers(table, "v"))
            size = np.diff(np.append(begin, len(x)))
            own = np.zeros((len(begin), n_states))
            full = np.flatnonzero(size == chunk)
            if len(full):
                own[full] = _run(stages, _columns(x, begin, size, full, chunk), np.zeros((n_states, len(full))))[1].T
            first = table.take(pa.array(begin))
            yield pa.RecordBatch.from_arrays([*(first[k].combine_chunks() for k in keys), pa.array(x[begin]), _arrays(own)], names=[*keys, "head", "own"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All streams at once: their first chunks, then the second ones of those that have any, and so on."""
        move = None
        for table, begin in whole(batches, [by]):
            own, out = _vectors(table["own"], n_states), np.empty((len(table), n_states))
            left = np.diff(np.append(begin, len(table)))
            at, state = begin, _begin(stages, zeros, numbers(table, "head")[begin]).T
            while len(at):
                out[at] = state
                more = left > 1
                if more.any() and move is None:
                    move = _run(stages, np.zeros((chunk, n_states)), np.eye(n_states))[1]
                state = state[more] @ move.T + own[at[more]] if more.any() else state[more]
                at, left = at[more] + 1, left[more] - 1
            yield pa.RecordBatch.from_arrays([*(table[k].combine_chunks() for k in keys), _arrays(out)], names=[*keys, "_state"])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each chunk is its state."""
        for table, begin in whole(batches, keys):
            x = np.nan_to_num(numbers(table, "v"))
            size = np.diff(np.append(begin, len(x))) - 1
            state = _vectors(table["_state"].take(pa.array(begin)), n_states)
            y = np.zeros(len(x))
            step = min(chunk, 128)
            height = -(-size // step) * step
            for h in np.unique(height[size > 0]).tolist():
                of = np.flatnonzero(height == h)
                out, _ = _run(stages, _columns(x, begin + 1, size, of, h), state[of].T)
                rows = np.concatenate([np.arange(size[k]) + begin[k] + 1 for k in of])
                y[rows] = np.concatenate([out[: size[k], c] for c, k in enumerate(of)])
            kept = np.ones(len(x), dtype=bool)
            kept[begin] = False
            rest = table.append_column("_y", pa.array(y)).filter(pa.array(kept)).combine_chunks()
            yield from rest.select(["_y" if c == "v" else c for c in columns]).rename_columns(columns).to_batches()

    def dealt(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    found = dealt(marked.select(*keys, "idx", F.col("v").cast("double").alias("v")), keys, "idx").mapInArrow(ends, f"`{by}` {of_stream}, _chunk bigint, head double, own array<double>")
    found = dealt(found, [by], "_chunk").mapInArrow(states, f"`{by}` {of_stream}, _chunk bigint, _state array<double>")
    both = marked.withColumn("v", F.col("v").cast("double")).unionByName(found.withColumn("idx", F.lit(-1)), allowMissingColumns=True)
    schema = StructType([StructField("v", DoubleType()) if f.name == "v" else f for f in df.schema])
    return dealt(both.withColumn("idx", F.col("idx").cast(df.schema["idx"].dataType)), keys, "idx").mapInArrow(final, schema)


def filtered(df: DataFrame, sections: filters.Sections, by: str = "stream", start: str = "cold", zeros: int = 0, chunk: int = CHUNK) -> DataFrame:
    """cascade() of a single filter."""
    return cascade(df, [(sections, start)], by, zeros, chunk)


def high_gamma(df: DataFrame, sr: float, line: int = 50, by: str = "stream", zeros: int = 0) -> DataFrame:
    """The band from 70 to 170 Hz without the mains' harmonics; the last stop starts warm, as in a stream."""
    stages = filters.high_gamma(sr, line)
    return cascade(df, [(s, "warm" if k == len(stages) - 1 else "cold") for k, s in enumerate(stages)], by, zeros)


def first_order(df: DataFrame, a: float, by: str = "stream") -> DataFrame:
    """stream, idx, v: y[n] = (1 - a) x[n] + a y[n-1] from rest."""
    return filtered(df.select(by, "idx", "v"), np.array([[1 - a, 0.0, 0.0, 1.0, -a, 0.0]]), by, "rest")


def decimated(df: DataFrame, factor: int, sr: float, by: str = "stream") -> DataFrame:
    """Every factor-th sample after a low-pass of eight poles run forwards and backwards, so without delay."""
    low = filters.butterworth(8, "low", (0.8 * sr / 2 / factor,), sr)
    forth = filtered(df.select(by, "idx", "v"), low, by)
    last = forth.groupBy(by).agg(F.max("idx").alias("_last"))
    turned = forth.join(last, by).withColumn("idx", F.col("_last") - F.col("idx"))
    back = filtered(turned, low, by).withColumn("idx", F.col("_last") - F.col("idx"))
    return back.where(F.col("idx") % factor == 0).select(by, (F.col("idx") / factor).cast("bigint").alias("idx"), "v")


def design_table(sections: Sequence[Sequence[float]]) -> list[tuple]:
    """Rows (section, b0, b1, b2, a1, a2)."""
    return [(k, *map(float, (s[0], s[1], s[2], s[4], s[5]))) for k, s in enumerate(sections)]
