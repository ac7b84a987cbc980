"""Features of streams whose input may change: a state that starts anew with each session, width or long silence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.features import Options
from .features import Features

#: Needed of the session: a state store that keeps values, maps and timers of a key.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

# built of types, as the processor has no session that could parse a text
_HEAD = StructType([StructField("session", StringType()), StructField("width", IntegerType()), StructField("run", LongType()), StructField("last", LongType())])
_CHANNEL = StructType([StructField("seen", LongType()), StructField("frame", LongType()), *(StructField(c, ArrayType(DoubleType())) for c in ("tail", "states", "lags"))])
_CH = StructType([StructField("ch", IntegerType())])


class _Frames(StatefulProcessor):
    """Of a stream: which session and width its state is of, and a Features for each channel.

    Another session, another number of channels, or samples that begin again at an earlier number, are an event: what was
    kept of the channels is cleared, and the timer of the silence with it, before the first sample after it counts.
    """

    def __init__(self, o: Options, by: str, silence_ms: int):
        self.o, self.by, self.silence = o, by, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.channels = handle.getMapState("channels", _CH, _CHANNEL)

    def _clear(self) -> None:
        for timer in list(self.handle.listTimers()) if self.silence else ():
            self.handle.deleteTimer(timer)
        self.channels.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        batch = pd.concat(list(rows)).sort_values(["at", "idx"], ignore_index=True)
        session, width, run, last = self.head.get() if self.head.exists() else (None, -1, -1, -1)
        widths = batch["x"].map(len)
        change = (batch["session"] != batch["session"].shift(fill_value=session)) | (widths != widths.shift(fill_value=width)) | (batch["idx"] <= batch["idx"].shift(fill_value=last))
        if not self.head.exists():
            change.iloc[0] = True
        own = [] if change.iloc[0] else [Features(self.o, tuple(self.channels.getValue((c,)))) for c in range(width)]
        out = []
        for _, part in batch.groupby(change.cumsum(), sort=True):
            x = np.array(part["x"].to_list(), dtype=float).reshape(len(part), -1)
            if change[part.index[0]]:
                own, run = [Features(self.o) for _ in range(x.shape[1])], run + 1
            session, width, last = part["session"].iloc[-1], x.shape[1], int(part["idx"].iloc[-1])
            made = [f.feed(x[:, c]) for c, f in enumerate(own)]
            out += [(key[0], session, run, rows[0][0], [r[1] for r in rows], [v for r in rows for v in r[2]]) for rows in zip(*made, strict=True)]
        self._clear()
        for c, f in enumerate(own):
            self.channels.updateValue((c,), f.state())
        self.head.update((session, width, run, last))
        if self.silence:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield pd.DataFrame(out, columns=[self.by, "session", "run", "frame", "energy", "features"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._clear()
        if self.head.exists():
            session, width, run, _ = self.head.get()
            self.head.update((None, -1, run, -1))
        yield pd.DataFrame(columns=[self.by, "session", "run", "frame", "energy", "features"])

    def close(self) -> None:
        pass


def neural(samples: DataFrame, o: Options, by: str = "stream", silence_ms: int = 0) -> DataFrame:
    """stream, session, run, frame, energy (of each channel) and features (channel by channel, oldest first) from a stream of samples (stream, session, at, idx, x).

    Within a batch the samples are put in the order of at and idx; from batch to batch they come in order.  Each change of a
    stream's session or of its number of channels begins a run, numbered from 0, whose frames are what they would
    be if nothing had been before; so does an idx that does not grow, and what comes after silence_ms without samples.
    The session needs the settings of STORE.
    """
    kind = dict(samples.dtypes)[by]
    out = StructType.fromDDL(f"{by} {kind}, session string, run bigint, frame bigint, energy array<double>, features array<double>")
    return samples.select(by, "session", "at", "idx", "x").groupBy(by).transformWithStateInPandas(_Frames(o, by, silence_ms), out, "append", "ProcessingTime" if silence_ms else "None")
