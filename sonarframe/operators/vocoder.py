"""Waves from log-mel spectra by the method of Griffin and Lim, block by block as a stream or for a whole utterance.

Both start from random samples, which come from a seed and the utterance's key, so a lost task makes them again.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import filters, mel


def stft(x: np.ndarray, window: np.ndarray, hop: int) -> np.ndarray:
    """Frames x bins; a frame ends before the last sample."""
    at = np.arange(0, len(x) - len(window), hop)
    return np.fft.rfft(x[at[:, None] + np.arange(len(window))] * window, axis=1) if len(at) else np.zeros((0, len(window) // 2 + 1), dtype=complex)


def istft(spectra: np.ndarray, window: np.ndarray, hop: int, n: int) -> np.ndarray:
    """n samples: the frames under the window, overlapping and added."""
    out = np.zeros(n)
    for k, i in enumerate(range(0, n - len(window), hop)):
        if k < len(spectra):
            out[i : i + len(window)] += np.fft.irfft(spectra[k], len(window)) * window
    return out


def refined(magnitude: np.ndarray, window: np.ndarray, hop: int, start: np.ndarray, rounds: int, phase: str = "complex") -> np.ndarray:
    """A wave with spectra near the magnitude.  phase "real" weighs by exp(angle) as some streams do, without the imaginary unit."""
    x = start
    for _ in range(rounds):
        own = stft(x, window, hop)[: len(magnitude)]
        turned = np.exp(np.angle(own) * (1j if phase == "complex" else 1.0))
        x = istft(magnitude[: len(own)] * turned, window, hop, len(x))
    return x


def utterance(log_mels: np.ndarray, rng: np.random.Generator, sr: int = 16000, length: float = 0.05, shift: float = 0.01, rounds: int = 8) -> np.ndarray:
    """16-bit samples of a whole utterance, the loudest at 32767."""
    size, hop = int(sr * length), int(int(sr * length) / (length / shift))
    if not len(log_mels):
        return np.zeros(0, dtype=np.int16)
    with np.errstate(over="ignore", invalid="ignore"):
        magnitude = np.exp(log_mels) @ mel.inverse(size // 2 + 1, log_mels.shape[1], sr).T
    magnitude[~np.isfinite(magnitude)] = 0.0
    window = np.hanning(size + 1)[:-1]
    x = refined(magnitude, window, hop, rng.random(size + hop * len(magnitude)), rounds)
    return np.int16(x / max(np.abs(x).max(), 1e-12) * 32767)


@dataclass
class Stream:
    """Frames in, samples out: `context` frames before and after make a block, and the oldest part of its wave is final.

    The state is a few frames and samples, so a stateful streaming query can keep it between batches.
    """

    sr: int = 16000
    length_ms: float = 16.0
    shift_ms: float = 10.0
    mels: int = 40
    rounds: int = 8
    cutoff: float = 7900.0
    norm: float = 1.0
    phase: str = "complex"
    seed: int = 0
    frames: list = field(default_factory=list)
    seen: int = 0
    wave: np.ndarray | None = None
    weight: np.ndarray | None = None
    low: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.size, self.hop = int(self.length_ms / 1000 * self.sr), int(self.shift_ms / 1000 * self.sr)
        self.context = int(self.length_ms / self.shift_ms)
        self.block = 2 * self.context + 1
        self.inverse = mel.inverse(self.size // 2 + 1, self.mels, self.sr)
        self.window = np.blackman(self.size)
        order = max(1, int(self.sr / 1000 * self.shift_ms / 32))
        self.sections = filters.butterworth(order, "low", (self.cutoff,), self.sr)
        if self.low is None:
            self.low = np.zeros((len(self.sections), 2, 1))
        if self.wave is None:
            self.wave, self.weight = np.zeros(self.block * self.hop), np.zeros(self.block * self.hop)

    def feed(self, frame: np.ndarray) -> np.ndarray:
        """The samples that this frame makes final: none at first, then as many as a shift has."""
        self.frames = [*self.frames, np.asarray(frame, dtype=float)][-(self.block - self.context) :]
        self.seen += 1
        self.wave = np.concatenate([self.wave[self.hop :], np.zeros(self.hop)])
        self.weight = np.concatenate([self.weight[self.hop :], np.zeros(self.hop)])
        if len(self.frames) < self.block - self.context:
            return np.zeros(0, dtype=np.int16)
        with np.errstate(over="ignore", invalid="ignore"):
            magnitude = np.exp(np.array(self.frames)) @ self.inverse.T
        magnitude[~np.isfinite(magnitude)] = 0.0
        n = self.block * self.hop
        start = np.random.default_rng([self.seed, self.seen]).random(n)
        x = refined(magnitude, self.window, self.hop, start, self.rounds, self.phase)
        self.wave, self.weight = self.wave + x, self.weight + np.blackman(n)
        w = self.weight[: self.hop]
        done = np.where(w != 0, self.wave[: self.hop] / np.where(w != 0, w, 1.0), self.wave[: self.hop])
        done, self.low = filters.run(self.sections, done[:, None], self.low)
        return np.int16(np.clip(done[:, 0] / (self.norm * 1.01), -0.99, 0.99) * (2**15 - 1))


def key_seed(key: object, seed: int) -> int:
    return zlib.crc32(repr((seed, key)).encode())


def griffin_lim(frames: DataFrame, by: str = "stream", streaming: bool = False, seed: int = 0, **options) -> DataFrame:
    """stream, idx, v (16-bit) from rows (stream, frame, mel); a group is one utterance."""
    kind = dict(frames.dtypes)[by]

    def make(part: pd.DataFrame) -> pd.DataFrame:
        mels = np.array(part.sort_values("frame")["mel"].to_list(), dtype=float)
        own = key_seed(part[by].iloc[0], seed)
        if streaming:
            s = Stream(mels=mels.shape[1], seed=own, **options)
            wave = np.concatenate([s.feed(f) for f in mels])
        else:
            wave = utterance(mels, np.random.default_rng(own), **options)
        key = part[by].iloc[:1].repeat(len(wave)).reset_index(drop=True)  # keeps its type where an utterance is too short to make a sample final
        return pd.DataFrame({by: key, "idx": np.arange(len(wave)), "v": wave})

    return frames.select(by, "frame", "mel").groupBy(by).applyInPandas(make, f"{by} {kind}, idx bigint, v smallint")
