"""16-bit PCM files: reading by tasks and writing one file for each group."""

from __future__ import annotations

import io
import struct
import uuid
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples x channels)"""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit samples are read")
        return w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())


def dump(samples: np.ndarray, sr: int) -> bytes:
    data = np.asarray(samples, dtype="<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, sr, 2 * sr, 2, 16, b"data", len(data)) + data


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, sr, idx, v (the first channel) of each file."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                sr, x = parse(content)
                for lo in range(0, len(x), 1 << 18):
                    piece = x[lo : lo + (1 << 18), 0]
                    yield pd.DataFrame({"path": p, "sr": sr, "idx": np.arange(lo, lo + len(piece)), "v": piece})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, sr int, idx bigint, v smallint")


def encoded(samples: DataFrame, sr: int, by: str = "trial") -> DataFrame:
    """trial and content, the bytes of a WAV file; a group is one recording of some seconds."""
    kind = dict(samples.dtypes)[by]

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: part[by].iloc[:1].to_list(), "content": [dump(part.sort_values("idx")["v"].to_numpy(), sr)]})

    return samples.select(by, "idx", F.col("v").cast("smallint").alias("v")).groupBy(by).applyInPandas(pack, f"{by} {kind}, content binary")


def trial_files(samples: DataFrame, trials: DataFrame, sr: int, by: str = "stream") -> DataFrame:
    """stream, name (number from 1 and word) and content of each trial (trial, word, first, end)."""
    from ..operators.joins import in_intervals

    cut = in_intervals(samples.select(by, "idx", "v"), trials.select(by, "trial", "word", "first", "end"), by, sr)
    name = F.concat_ws("-", F.format_string("%03d", F.col("trial") + 1), "word")
    return encoded(cut.select(F.concat_ws("/", F.col(by).cast("string"), name).alias("name"), "idx", "v"), sr, "name")


def write_files(files: DataFrame, folder: str) -> None:
    """Write each row's content to folder/name.wav; the folder is one that all tasks share.

    A file gets its name when it is whole, so a task that is run again leaves no half of one.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                target = Path(folder, f"{name}.wav")
                target.parent.mkdir(parents=True, exist_ok=True)
                part = target.with_suffix(f".{uuid.uuid4().hex}")
                part.write_bytes(content)
                part.replace(target)
            yield batch[["name"]]

    files.select("name", "content").mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
