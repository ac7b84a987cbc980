"""The evaluations as DataFrames: cross-validated reconstruction, chance levels, matching words, speech in and out of trials."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dtw, frames, joins, lda, quantize, statistics
from .staging import staged


def trial_grid(words: DataFrame, sr: float, seconds: float, by: str = "stream") -> DataFrame:
    """Adds first, the sample at which a session's trial begins; trials are numbered from 0."""
    return words.withColumn("first", (F.col("trial") * int(seconds * sr)).cast("bigint"))


def speech_seconds(voiced: DataFrame, trials: DataFrame, shift: float, by: str = "stream") -> DataFrame:
    """stream, in_trials, in_rest: seconds of voiced frames (stream, idx, voiced) inside and outside of trials.

    What comes before a stream's first or after its last trial is not counted; a stream without trials has none.
    """
    span = trials.groupBy(by).agg(F.min("first").alias("_lo"), F.max("end").alias("_hi"))
    inside = joins.mask(voiced, trials, by).join(span, by, "left")
    counted = F.col("voiced") & F.coalesce((F.col("idx") >= F.col("_lo")) & (F.col("idx") < F.col("_hi")), F.lit(False))
    return inside.groupBy(by).agg((F.count_if(counted & F.col("inside")) * shift).alias("in_trials"), (F.count_if(counted & ~F.col("inside")) * shift).alias("in_rest"))


#: Bytes of models that are fitted, and sent out, together.
MODELS = 64 << 20


def reconstructed(df: DataFrame, x: str, y: str, k: int = 10, levels: int = 9, run: int | Sequence[int] = 0, seed: int = 0, features: int | None = None) -> DataFrame:
    """frame, fold, run, orig, reco of a cross-validation in k contiguous folds of frames (frame, x, y; numbered from 0).

    Each fold's codebook, feature choice and models come from the other folds; a job each makes those of all
    folds, and of all runs, together.  With run > 0 the features are rotated against the targets by a seeded number of
    frames, which breaks what they have in common.  Of many runs, those go together whose models are within MODELS bytes.
    """
    runs = [run] if isinstance(run, int) else list(run)
    n = df.count()
    both = frames.folds(df.select("frame", F.col(x).alias("x"), F.col(y).alias("y")), k)
    ranges = both.select("fold", F.posexplode("y").alias("bin", "v")).groupBy("fold", "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: p != F.col("fold"))).alias("part")
    cells = ranges.select(others, "bin", "lo", "hi").groupBy(F.struct("part", "bin").alias("cell")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    book = sorted(quantize.logistic_from_ranges(cells, levels, "cell").collect())  # a row for each fold and bin
    width = features or (both.select(F.max(F.size("x"))).first()[0] or 0)
    at_once = max(1, MODELS // max(1, 8 * levels * (width + 1) * len(book)))
    turns = {r: int(np.random.default_rng([seed, r]).integers(0, n)) if r and n else 0 for r in runs}
    out = None
    for lo in range(0, len(runs), at_once):
        some = _reconstructed(both, {r: turns[r] for r in runs[lo : lo + at_once]}, n, k, book, features)
        out = some if out is None else out.unionByName(some)
    return out


def _reconstructed(both: DataFrame, turns: dict[int, int], n: int, k: int, book: list, features: int | None) -> DataFrame:
    """The runs of these turns, whose folds are told apart as cells: k for each run."""

    def by_part(column: str) -> Column:
        return F.array(*(F.array(*(F.array(*map(F.lit, r[column])) for r in book if r["cell"]["part"] == p)) for p in range(k)))

    number = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).alias("run"), F.lit(t).cast("bigint").alias("turn")) for i, (r, t) in enumerate(turns.items())))).alias("_run")
    if any(turns.values()):
        sides = both.select("frame", "fold", "y", number)
        sides = sides.withColumn("_from", F.pmod(F.col("frame") + F.col("_run.turn"), F.lit(n)))
        both = sides.join(both.select(F.col("frame").alias("_from"), "x"), "_from")
    else:
        both = both.select("frame", "fold", "x", "y", number)
    both = both.select("frame", F.col("_run.run").alias("run"), "fold", "x", "y", (F.col("_run.i") * k + F.col("fold")).alias("cell"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: p != F.col("fold"))).alias("part")
    rest = both.select("frame", "x", "y", (F.col("cell") - F.col("fold")).alias("_first"), others).withColumn("cell", F.col("_first") + F.col("part"))
    if features is not None:
        chosen = select_features_outside(both, features, k)
        picks = F.array(*(F.array(*map(F.lit, chosen.get(p, []))).cast("array<int>") for p in range(k * len(turns))))
        picked = lambda df: df.withColumn("x", F.transform(F.get(picks, F.col("cell").cast("int")), lambda i: F.get("x", i)))
        rest, both = picked(rest), picked(both)
    borders, medians = (by_part(c) for c in ("borders", "medians"))
    coded = rest.withColumn("levels", F.transform("y", lambda v, i: quantize.level(v, F.get(F.get(borders, F.col("part")), i))))
    models = lda.fit_by(coded, "cell", "x", "levels")
    found = lda.predicted(both, "x", models, "cell")
    reco = F.transform("predicted", lambda c, i: F.get(F.get(F.get(medians, F.col("fold").cast("int")), i), c.cast("int")))
    return found.select("frame", "fold", "run", F.col("y").alias("orig"), reco.alias("reco"))


def select_features_by(df: DataFrame, by: str, k: int, x: str = "x", y: str = "y") -> dict[int, list[int]]:
    """For each `by` the positions of the k features that correlate most by ranks with the mean of the target, in ascending order of that; of equal ones the later is stronger."""
    from ..functions import arrays

    ranked = statistics.ranks(df.select(by, F.col(x).alias("x"), arrays.mean(y).alias("target")), "target", by, "rank")
    long = ranked.select(by, "rank", F.posexplode("x").alias("feature", "v")).select(F.struct(by, "feature").alias("cell"), "rank", "v")
    return _strongest(statistics.spearman(long, "cell", "v", "rank", ranked=True).select("cell.*", "rho"), by, k)


def select_features_outside(df: DataFrame, features: int, k: int, x: str = "x", y: str = "y") -> dict[int, list[int]]:
    """select_features_by() for each cell, run * k + fold, of the rows (cell, fold, x, y) of its run that are in other folds, without repeating the rows."""
    from ..functions import arrays

    rows = df.select((F.col("cell") - F.col("fold")).alias("_run"), "fold", F.col(x).alias("x"), arrays.mean(y).alias("target"))
    ranked = staged(statistics.ranks_outside(rows, "target", "_run", k, "_rt"), "ranked")
    long = ranked.select("_run", "fold", "_rt", F.posexplode("x").alias("feature", "v")).select(F.struct("_run", "feature").alias("_group"), "fold", "_rt", "v")
    both = statistics.ranks_outside(long, "v", "_group", k, "_rx")
    part = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda p: p != F.col("fold"))).alias("_p")
    each = both.select("_group", "_rx", "_rt", "v", part).select((F.col("_group._run") + F.col("_p")).alias("cell"), F.col("_group.feature").alias("feature"), F.get("_rx", F.col("_p")).alias("_rx"), F.get("_rt", F.col("_p")).alias("_rt"), "v")
    return _strongest(statistics.of_ranks(each, "v", "cell", "feature"), "cell", features)


def _strongest(rho: DataFrame, by: str, k: int) -> dict[int, list[int]]:
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.abs("rho")), F.desc("feature")))
    out: dict[int, list[int]] = {}
    for r in rho.withColumn("order", order).where(F.col("order") <= k).orderBy(by, F.desc("order")).collect():  # k rows each
        out.setdefault(r[by], []).append(r["feature"])
    return out


def select_features(df: DataFrame, k: int, x: str = "x", y: str = "y") -> list[int]:
    """select_features_by() of all rows."""
    return select_features_by(df.withColumn("_one", F.lit(0)), "_one", k, x, y).get(0, [])


def correlations(reco: DataFrame, *by: str) -> DataFrame:
    """by, bin and r of the original and the reconstructed spectra."""
    long = reco.select(*by, F.posexplode(F.arrays_zip("orig", "reco")).alias("bin", "_p")).select(*by, F.col("bin").cast("bigint").alias("bin"), "_p.orig", "_p.reco")
    return long.groupBy(*by, "bin").agg(statistics.pearson("orig", "reco").alias("r"))


def over_runs(r: DataFrame, *by: str) -> DataFrame:
    """by, mean and population std of r over folds or runs; undefined ones are left out."""
    return r.groupBy(*by).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"))


def random_segments(streams: DataFrame, runs: int, length: int, seed: int = 0, by: str = "stream") -> DataFrame:
    """run, stream, first, end: for each run and stream (stream, n samples) a segment of `length` samples from a seeded place; too short streams have none."""
    spread = streams.where(F.col("n") > length).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(by).cast("string"), F.col("run").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")
    first = drawn % (F.col("n") - length)
    return spread.select("run", by, first.alias("first"), (first + length).alias("end"))


def matching(decoded: DataFrame, training: DataFrame) -> DataFrame:
    """word and r: of words in both sessions, first occurrences, the training spectra warped to the decoded ones.

    Both sides are (word, trial, frame, mel).
    """
    first = lambda d: d.join(d.groupBy("word").agg(F.min("trial").alias("trial")), ["word", "trial"], "left_semi")
    a, b = first(decoded), first(training)
    sides = a.join(b.select("word").distinct(), "word", "left_semi").withColumn("side", F.lit(0)).unionByName(b.join(a.select("word").distinct(), "word", "left_semi").withColumn("side", F.lit(1)))
    return dtw.warped_correlation(sides, "word")


def trial_frames(trials: DataFrame, sr: int, shift: float = 0.01, seconds: int = 2, at: str = "start") -> DataFrame:
    """Adds first and end, the frames of a trial that begins at a sample: from the next whole shift on, for so many seconds."""
    step = int(shift * sr)
    return trials.withColumn("first", F.ceil(F.col(at) / step)).withColumn("end", F.col("first") + seconds * sr // step)


def trial_mask(streams: DataFrame, trials: DataFrame, sr: int, shift: float = 0.01, context: int = 5, by: str = "stream") -> DataFrame:
    """stream, idx, inside: whether each frame of a stream (stream, n samples) belongs to a trial (stream, start).

    There are as many frames as whole shifts, less the context of the voice detection.
    """
    frames_ = F.floor(F.col("n") / int(shift * sr)) - context
    grid = streams.where(frames_ > 0).select(by, F.explode(F.sequence(F.lit(0).cast("bigint"), frames_ - 1)).alias("idx"))
    return joins.mask(grid, trial_frames(trials, sr, shift).select(by, "first", "end"), by)


def chance(decoded: DataFrame, words: DataFrame, n_words: int) -> DataFrame:
    """run, word and r: spectra decoded from random segments of unrelated recordings, each against a training word, in turn.

    decoded is (run, frame, mel), words (item from 0, word, frame, mel); the words are warped to the segments.
    """
    runs = joins.cycled(decoded.select("run").distinct(), words.select("item", "word").distinct(), n_words)
    sides = decoded.join(runs.select("run"), "run").select("run", F.lit(0).alias("side"), "frame", "mel")
    other = runs.join(words.drop("word"), "item").select("run", F.lit(1).alias("side"), "frame", "mel")
    return dtw.warped_correlation(sides.unionByName(other), "run").join(runs.select("run", "word"), "run")


def resynthesised(reco: DataFrame, trials: DataFrame, sr: int = 16000, by: str = "stream", **options) -> DataFrame:
    """name and content, a WAV file for each trial (stream, trial, word, first, end in samples), of spectra (stream, frame, mel) made audible."""
    from ..sources import wav
    from . import vocoder

    return wav.trial_files(vocoder.griffin_lim(reco, by, streaming=True, **options), trials, sr, by)


def shares_of_trials(r: DataFrame, keep: int = 5) -> DataFrame:
    """The trials of the highest mean correlation; undefined ones rank first, of equal ones the later."""
    mean = F.coalesce("r", F.lit(float("nan")))
    return r.orderBy(F.desc(mean), F.desc("trial")).limit(keep)


def occurrences(words: DataFrame, by: str = "stream") -> DataFrame:
    """Adds occurrence, from 1, of each word within its session."""
    return words.withColumn("occurrence", F.row_number().over(Window.partitionBy(by, "word").orderBy("trial")))
