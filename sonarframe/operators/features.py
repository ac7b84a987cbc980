"""From signals to features: filters, frames, log energy, stacking; the same as a stream emits them and in batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filtering, frames


@dataclass(frozen=True)
class Options:
    sr: float = 1024
    length_ms: float = 50
    shift_ms: float = 10
    order: int = 4
    step: int = 5
    line_noise: int = 50
    warm: bool = True
    stack: bool = True

    @property
    def lead(self) -> int:
        """Zeros that a warm start puts before the first sample."""
        return int(self.length_ms / 1000 * self.sr) - int(self.shift_ms / 1000 * self.sr)


def neural(samples: DataFrame, o: Options, by: str = "stream") -> DataFrame:
    """stream, frame, energy and, if asked for, features, as a stream emits them.

    With a warm start the first frame is made of zeros and the first shift of samples, so frames begin at once.
    """
    filtered = filtering.high_gamma(samples.select(by, "idx", "v"), o.sr, o.line_noise, by, o.lead if o.warm else 0)
    if o.warm:
        filtered = filtered.withColumn("idx", F.col("idx") + o.lead)
    sizes = frames.lengths(samples.withColumn("idx", F.col("idx") + (o.lead if o.warm else 0)), by)
    made = frames.log_energy(frames.framed(filtered, o.sr, o.length_ms, o.shift_ms, by, sizes), by)
    return frames.stacked(made, by=by, order=o.order, step=o.step) if o.stack else made


def neural_batch(samples: DataFrame, o: Options, by: str = "stream") -> DataFrame:
    """The batch twin: frames from the first sample on, and no features for frames without enough before them."""
    filtered = filtering.high_gamma(samples.select(by, "idx", "v"), o.sr, o.line_noise, by, o.lead)
    made = frames.log_energy(frames.batch_framed(filtered, o.sr, o.length_ms, o.shift_ms, by, frames.lengths(samples, by)), by)
    return frames.stacked(made, by=by, order=o.order, step=o.step, pad=False) if o.stack else made


def names(channels: list[str], order: int = 4) -> list[str]:
    """The names of the elements of vectors(): channel and lag, the oldest first."""
    return [f"{c}-{lag}" for c in channels for lag in range(order, -1, -1)]


def vectors(made: DataFrame, column: str = "features", session: str = "session", channel: str = "ch") -> DataFrame:
    """session, frame, x: the features of all channels behind one another, channel by channel, each oldest first."""
    rows = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(channel, column))), lambda s: s[column]))
    return made.groupBy(session, "frame").agg(rows.alias("x"))
