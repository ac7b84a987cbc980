"""Streaming twins of the batch operators: state for each stream, kept by Spark from batch to batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import filters
from ..operators.features import Options
from ..operators.vocoder import Stream, key_seed

STATE = "seen bigint, frame bigint, tail array<double>, states array<double>, lags array<double>"


class Features:
    """Samples of one stream in, frames out, however the samples are cut into batches."""

    def __init__(self, o: Options, state: tuple | None = None):
        self.o, self.stages = o, filters.high_gamma(o.sr, o.line_noise)
        self.size = int(o.length_ms / 1000 * o.sr)
        self.seen, self.frame, tail, states, lags = state or (0, 0, [], [], [])
        self.tail, self.lags = np.array(tail, dtype=float), list(lags)
        self.states, at = [], 0
        for s in self.stages if states else ():
            n = 2 * len(s)
            self.states.append(np.array(states[at : at + n], dtype=float).reshape(len(s), 2, 1))
            at += n

    def end(self, frame: int) -> int:
        """Where a frame ends, in samples since the beginning."""
        return self.size if frame == 0 else round((frame * self.o.shift_ms + self.size / self.o.sr * 1000) / 1000 * self.o.sr)

    def feed(self, x: np.ndarray) -> list[tuple[int, float, list[float]]]:
        """(frame, energy, features) of the frames that end within these samples."""
        if not len(x):
            return []
        x = np.asarray(x, dtype=float)[:, None]
        if not self.states:
            lead = self.o.lead if self.o.warm else 0
            self.tail, self.seen = np.zeros(lead), lead
            y = x
            for k, s in enumerate(self.stages):
                last = k == len(self.stages) - 1
                self.states.append(filters.warm(s, 1, lead) if last else filters.cold(s, y[0]))
                y, self.states[k] = filters.run(s, y, self.states[k])
        else:
            y = x
            for k, s in enumerate(self.stages):
                y, self.states[k] = filters.run(s, y, self.states[k])
        self.tail = np.concatenate([self.tail, y[:, 0]])
        self.seen += len(y)
        out = []
        while (end := self.end(self.frame)) <= self.seen:
            at = len(self.tail) - (self.seen - end)
            energy = float(np.log((self.tail[at - self.size : at] ** 2).sum() + 0.01))
            self.lags = [*self.lags, energy][-(self.o.order * self.o.step + 1) :]
            past = [0.0] * (self.o.order * self.o.step + 1 - len(self.lags)) + self.lags
            out.append((self.frame, energy, past[:: self.o.step]))
            self.frame += 1
        keep = self.seen - (self.end(self.frame) - self.size)
        self.tail = self.tail[max(0, len(self.tail) - keep) :] if keep > 0 else self.tail[:0]
        return out

    def state(self) -> tuple:
        return self.seen, self.frame, self.tail.tolist(), np.concatenate([s.ravel() for s in self.states]).tolist() if self.states else [], self.lags


def neural(samples: DataFrame, o: Options, by: str = "stream") -> DataFrame:
    """stream, frame, energy, features from a stream of samples (stream, idx, v).

    Within a batch the samples are put in order; from batch to batch they come in order, as a source that
    plays one recording per stream hands them out.
    """
    kind = dict(samples.dtypes)[by]

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Features(o, state.get if state.exists else None)
        batch = pd.concat(list(parts)).sort_values("idx")
        rows = own.feed(batch["v"].to_numpy(dtype=float))
        state.update(own.state())
        yield pd.DataFrame({by: [key[0]] * len(rows), "frame": [r[0] for r in rows], "energy": [r[1] for r in rows], "features": [r[2] for r in rows]})

    return samples.select(by, "idx", "v").groupBy(by).applyInPandasWithState(step, f"{by} {kind}, frame bigint, energy double, features array<double>", STATE, "append", GroupStateTimeout.NoTimeout)


VOICE = "seen bigint, frames array<double>, wave array<double>, weight array<double>, low array<double>"


def vocoded(frames: DataFrame, by: str = "stream", mels: int = 40, seed: int = 0, **options) -> DataFrame:
    """stream, frame, wave (16-bit samples) from a stream of log-mel frames (stream, frame, mel); the first frame makes none."""
    kind = dict(frames.dtypes)[by]

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Stream(mels=mels, seed=key_seed(key[0], seed), **options)
        if state.exists:
            own.seen, flat, wave, weight, low = state.get
            own.frames = list(np.array(flat, dtype=float).reshape(-1, mels))
            own.wave, own.weight = np.array(wave), np.array(weight)
            own.low = np.array(low).reshape(own.low.shape)
        batch = pd.concat(list(parts)).sort_values("frame")
        waves = [own.feed(m).tolist() for m in batch["mel"]]
        state.update((own.seen, np.concatenate(own.frames).tolist(), own.wave.tolist(), own.weight.tolist(), own.low.ravel().tolist()))
        yield pd.DataFrame({by: [key[0]] * len(waves), "frame": batch["frame"].to_list(), "wave": waves})

    return frames.select(by, "frame", "mel").groupBy(by).applyInPandasWithState(step, f"{by} {kind}, frame bigint, wave array<smallint>", VOICE, "append", GroupStateTimeout.NoTimeout)


def reblocked(samples: DataFrame, size: int, by: str = "stream") -> DataFrame:
    """stream, block, block_values: full blocks of `size` samples as soon as they are there; the rest waits in the state."""
    kind = dict(samples.dtypes)[by]

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, waiting = state.get if state.exists else (0, [])
        values = [*waiting, *pd.concat(list(parts)).sort_values("idx")["v"].tolist()]
        full = len(values) // size
        state.update((block + full, values[full * size :]))
        yield pd.DataFrame({by: [key[0]] * full, "block": range(block, block + full), "block_values": [values[k * size : (k + 1) * size] for k in range(full)]})

    return samples.select(by, "idx", "v").groupBy(by).applyInPandasWithState(step, f"{by} {kind}, block bigint, block_values array<double>", "block bigint, waiting array<double>", "append", GroupStateTimeout.NoTimeout)


def markers_between(samples: DataFrame, markers: DataFrame, delay: str = "10 seconds", by: str = "stream") -> DataFrame:
    """Samples of a stream with the markers of the same second; both sides have a watermark on ts, so state is dropped in time."""
    a = samples.withColumn("second", F.date_trunc("second", "ts")).withWatermark("second", delay)
    b = markers.select(by, F.date_trunc("second", "ts").alias("second"), "label").withWatermark("second", delay)
    return a.join(b, [by, "second"])
