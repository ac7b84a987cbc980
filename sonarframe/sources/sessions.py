"""A session of single words, and a run of decoding, as one load each with one schema; models and decodings as stored tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio, filtering, lda, select
from . import labels, recordings, wav


def signal(rows: DataFrame) -> DataFrame:
    """session, kind ("sEEG" or "Audio"), sr, ch, idx, v from wide rows (session, kind, sr, idx, x): what every loader here returns."""
    return recordings.long(rows, "session", "kind", "sr").select("session", "kind", F.col("sr").cast("int").alias("sr"), F.col("ch").cast("int").alias("ch"), "idx", F.col("v").cast("double").alias("v"))


def session(samples: DataFrame, downsample: bool = True, noise: float = 1e-4, seed: int = 0) -> DataFrame:
    """A session's samples as signal() has them; the audio is decimated by 3, then taken as of 16 kHz, and gets some noise."""
    neural, sound = samples.where("kind = 'sEEG'"), samples.where("kind = 'Audio' and ch = 0")
    if downsample:
        rate = 48000.0
        sound = filtering.decimated(sound.select("session", "idx", "v"), 3, rate, "session").select("session", F.lit("Audio").alias("kind"), F.lit(16000).alias("sr"), F.lit(0).alias("ch"), "idx", "v")
    return neural.unionByName(audio.with_noise(sound, noise, seed).select(*neural.columns))


def _name(path: str = "path"):
    """The folder that a file is in."""
    return F.element_at(F.split(path, "/"), -2)


def session_folder(spark: SparkSession, folder: str, file: str = "speech1.hdf", **options) -> tuple[DataFrame, DataFrame]:
    """(session(), trials()) of a session's folder; with a pattern, of all that it matches, each under its folder's name."""
    rows = recordings.read_hdf5(spark, f"{folder}/{file}").select(_name().alias("session"), "kind", "sr", "idx", "x")
    marks = recordings.markers(spark, f"{folder}/{file}").select(_name().alias("session"), "idx", "label")
    return session(signal(rows), **options), trials(marks)


def run_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(signal() of what was decoded and received; session, trial, word, seconds) of a decoding run's folder, or of all that a pattern matches.

    The folder has audio.wav, sEEG.hdf, markers.csv and first_timestamp.npy, whose one number is the time at which the received signal begins.
    """
    from ..operators.blocks import running

    sound = wav.read(spark, f"{folder}/audio.wav").select(_name().alias("session"), F.lit("Audio").alias("kind"), "sr", "idx", F.array(F.col("v").cast("double")).alias("x"))
    received = recordings.read_hdf5(spark, f"{folder}/sEEG.hdf").select(_name().alias("session"), "kind", "sr", "idx", "x")

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "begin": [float(np.load(io.BytesIO(c)).ravel()[0]) for c in batch["content"]]})

    stamps = spark.read.format("binaryFile").load(f"{folder}/first_timestamp.npy").select(F.col("_metadata.file_path").alias("path"), "content").mapInPandas(begin, "path string, begin double")
    marks = labels.read_markers(spark, f"{folder}/markers.csv").withColumn("path", F.col("_metadata.file_path"))
    marks = marks.select(_name().alias("session"), "recorded_at", "monotonic_time", "label").join(stamps.select(_name().alias("session"), "begin"), "session")
    starts = labels.trial_starts(marks, F.col("begin"), 1.0, keep=("session",)).withColumn("_one", F.lit(1))
    found = running(starts, "_one", "_n", "session", "seconds")
    return signal(sound.unionByName(received)), found.select("session", (F.col("_n") - 1).alias("trial"), "word", "seconds")


def trials(markers: DataFrame, seconds: int = 3, prefix: str = "start;", by: str = "session") -> DataFrame:
    """session, trial (from 0), word and seconds at which it begins, from markers (session, idx, label): each trial takes so long."""
    from ..operators.blocks import running

    found = running(markers.where(F.col("label").startswith(prefix)).withColumn("_one", F.lit(1)), "_one", "_n", by, "idx")
    return found.select(by, (F.col("_n") - 1).alias("trial"), F.trim(F.expr(f"substring(label, {len(prefix) + 1})")).alias("word"), ((F.col("_n") - 1) * seconds).cast("double").alias("seconds"))


def cut(samples: DataFrame, trials: DataFrame, seconds: float = 2.0, by: str = "session") -> DataFrame:
    """session, trial, word, kind, sr, ch, idx (from 0 in the trial), v of the samples of each trial (session, trial, word, seconds) and so long after."""
    from ..operators.joins import in_intervals

    rates = samples.select(by, "kind", "sr").distinct()
    spans = trials.join(rates, by).withColumns({"first": F.floor(F.col("seconds") * F.col("sr")), "_key": F.concat_ws("#", F.col(by).cast("string"), "kind")})
    spans = spans.withColumn("end", F.col("first") + F.floor(F.lit(seconds) * F.col("sr"))).select("_key", "trial", "word", "first", "end")
    keyed = samples.withColumn("_key", F.concat_ws("#", F.col(by).cast("string"), "kind"))
    found = in_intervals(keyed, spans, "_key", 4096)
    return found.select(by, "trial", "word", "kind", "sr", "ch", (F.col("idx") - F.col("first")).alias("idx"), "v")


def decoding_run(spark: SparkSession, audio_path: str, markers_path: str, first_timestamp: float, run: str = "run") -> tuple[DataFrame, DataFrame]:
    """(signal() of the decoded audio; session, trial, word, seconds of its trials) of a run's WAV file and marker file."""
    from ..operators.blocks import running

    rows = wav.read(spark, audio_path).select(F.lit(run).alias("session"), F.lit("Audio").alias("kind"), "sr", F.lit(0).alias("ch"), "idx", F.col("v").cast("double").alias("v"))
    found = labels.trial_starts(labels.read_markers(spark, markers_path), first_timestamp, 1.0).withColumns({"session": F.lit(run), "_one": F.lit(1)})
    found = running(found, "_one", "_n", "session", "seconds")
    return rows, found.select("session", (F.col("_n") - 1).alias("trial"), "word", "seconds")


def common_duration(samples: DataFrame, by: str = "session") -> DataFrame:
    """Samples of each session cut to the seconds that all its kinds, of different rates, have."""
    lengths = samples.groupBy(by, "kind", "sr").agg((F.max("idx") + 1).alias("_n"))
    least = lengths.groupBy(by).agg(F.min(F.col("_n") / F.col("sr")).alias("_s"))
    return samples.join(least, by).where(F.col("idx") < F.floor(F.col("_s") * F.col("sr"))).drop("_s")


def store_training(path: str, codebook: DataFrame, models: list[lda.Model], selection: list[int], bad_channels: list[int], features: DataFrame) -> None:
    """What training leaves: the codebook, the models, the selected features, the channels left out and the training features, as tables below path."""
    spark = features.sparkSession
    codebook.write.mode("overwrite").parquet(f"{path}/codebook")
    lda.table(spark, models).write.mode("overwrite").parquet(f"{path}/models")
    spark.createDataFrame(list(enumerate(map(int, selection))), "pos bigint, feature bigint").write.mode("overwrite").parquet(f"{path}/selection")
    spark.createDataFrame([(int(k),) for k in bad_channels], "ch bigint").write.mode("overwrite").parquet(f"{path}/bad_channels")
    features.write.mode("overwrite").parquet(f"{path}/training_features")


def load_training(spark: SparkSession, path: str) -> tuple[DataFrame, list[lda.Model], list[int], list[int]]:
    """(codebook, models, selection, bad channels) of store_training()."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    selection = [r["feature"] for r in read("selection").orderBy("pos").collect()]
    return read("codebook"), lda.from_table(read("models")), selection, sorted(r["ch"] for r in read("bad_channels").collect())


def decoded(features: DataFrame, path: str, x: str = "x") -> DataFrame:
    """features with mel: the medians of the levels that the stored models predict from the selected features."""
    codebook, models, selection, _ = load_training(features.sparkSession, path)
    medians = [r["medians"] for r in sorted(codebook.collect(), key=lambda r: r["bin"])]  # a row for each bin
    found = lda.predicted(features.withColumn(x, select.pick(x, selection)), x, models)
    table = F.array(*(F.array(*map(F.lit, m)) for m in medians))
    return found.withColumn("mel", F.transform("predicted", lambda c, i: F.get(F.get(table, i), c.cast("int")))).drop("predicted")


def store_decoding(path: str, spectrogram: DataFrame, sound: DataFrame, received: DataFrame, options: dict[str, str]) -> None:
    """What a decoding leaves: the spectrogram, the audio, the received signal and the options, as tables below path."""
    for name, df in {"spectrogram": spectrogram, "audio": sound, "sEEG": received}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spectrogram.sparkSession.createDataFrame(sorted(options.items()), "option string, value string").write.mode("overwrite").parquet(f"{path}/options")
