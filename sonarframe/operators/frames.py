"""Framing, stacking and run lengths over numbered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, last_known, previous, running, with_halo, without_halo
from .staging import beside, staged


def online_ends(n: str | Column, sr: float, length_ms: float, shift_ms: float) -> Column:
    """End positions of the frames that fit into n samples, as a stream emits them.

    The first ends at the frame's size, later ones at that plus whole shifts in milliseconds, to the
    nearest sample, half to even.
    """
    size = int(length_ms / 1000 * sr)
    count = F.floor((n - size) / (shift_ms / 1000 * sr)).cast("int") + 1
    ends = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda k: F.bround((k * shift_ms + size / sr * 1000) / 1000 * sr, 0).cast("bigint"))
    return F.filter(ends, lambda e: (e <= n))


def lengths(samples: DataFrame, by: str, name: str = "_n") -> DataFrame:
    """by and how many samples, numbered from 0, each stream has: a row for each, summed inside tasks."""
    return staged(samples.groupBy(by).agg((F.max("idx") + 1).alias(name)), "lengths")


def framed(samples: DataFrame, sr: float, length_ms: float = 50, shift_ms: float = 10, by: str = "stream", sizes: DataFrame | None = None) -> DataFrame:
    """stream, frame, idx, v: each sample once for each frame that holds it.

    A sample finds its frames by arithmetic on its position, so there is no join: the candidates are the
    few frames whose nominal ends are near, and the exact ends decide.  sizes are the lengths() of the streams, where
    they can be had without working out the samples.
    """
    size = int(length_ms / 1000 * sr)
    shift = shift_ms / 1000 * sr
    low = F.greatest(F.floor((F.col("idx") - size) / shift) - 1, F.lit(0))
    high = F.floor(F.col("idx") / shift) + 1
    out = beside(samples, lengths(samples, by) if sizes is None else sizes, [by]).withColumn("frame", F.explode(F.sequence(low, high)))
    end = F.bround((F.col("frame") * shift_ms + size / sr * 1000) / 1000 * sr, 0).cast("bigint")
    out = out.withColumn("_end", F.when(F.col("frame") == 0, size).otherwise(end))
    return out.where((F.col("idx") < F.col("_end")) & (F.col("idx") >= F.col("_end") - size) & (F.col("_end") <= F.col("_n"))).drop("_n", "_end")


def batch_framed(samples: DataFrame, sr: float, length_ms: float = 50, shift_ms: float = 10, by: str = "stream", sizes: DataFrame | None = None) -> DataFrame:
    """As framed(), with the frames of the batch twin: frame k begins at round(k * shift) and there are floor((n - size) / shift) + 1."""
    size, shift = length_ms / 1000 * sr, shift_ms / 1000 * sr
    low = F.greatest(F.floor((F.col("idx") - size) / shift) - 1, F.lit(0))
    out = beside(samples, lengths(samples, by) if sizes is None else sizes, [by]).withColumn("frame", F.explode(F.sequence(low, F.floor(F.col("idx") / shift) + 1)))
    begin = F.bround(F.col("frame") * shift, 0)
    return out.where((F.col("frame") < F.floor((F.col("_n") - size) / shift) + 1) & (F.col("idx") >= begin) & (F.col("idx") < begin + int(size))).drop("_n")


def log_energy(frames: DataFrame, by: str = "stream") -> DataFrame:
    """stream, frame, energy: the logarithm of the sum of squares plus 0.01."""
    return frames.groupBy(by, "frame").agg(F.log(F.sum(F.col("v") * F.col("v")) + 0.01).alias("energy"))


def stacked(frames: DataFrame, value: str = "energy", by: str = "stream", order: int = 4, step: int = 5, pad: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds features: the values of the frames order * step, ..., step, 0 before, oldest first; frames are numbered without gaps.

    With pad, as a stream does it, frames before the first are 0; without, as in batch, frames with
    fewer before them than that are left out and the rest are numbered from 0.
    """
    skip = order * step
    w = Window.partitionBy(by, "_block").orderBy("frame")
    lags = [F.lag(value, step * k).over(w) if k else F.col(value) for k in range(order, -1, -1)]
    lags = [F.coalesce(x, F.lit(0.0)) for x in lags] if pad else lags
    out = without_halo(with_halo(frames, "frame", skip, 0, block).withColumn("features", F.array(*lags)), "frame", block)
    return out if pad else out.where(F.col("frame") >= skip).withColumn("frame", F.col("frame") - skip)


def ordered_means(frames: DataFrame, value: str, by: str, idx: str = "frame", block: int = BLOCK) -> DataFrame:
    """_by and _mean: each stream's mean, added up in the order of idx within blocks and then from block to block.

    So its last digit, which decides for values that are just as far from the mean as a threshold, is the same however the rows are dealt.
    """
    added = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("at"), F.col(value).cast("double").alias("v")))))
    parts = frames.groupBy(F.col(by).alias("_by"), F.floor(F.col(idx) / block).alias("_b")).agg(rows.alias("_rows"))
    parts = parts.select("_by", F.struct(F.col("_b").alias("at"), added(F.col("_rows.v")).alias("v"), F.size("_rows").alias("n")).alias("_part"))
    ends = parts.groupBy("_by").agg(F.array_sort(F.collect_list("_part")).alias("_parts"), F.sum("_part.n").alias("_n"))
    return ends.select("_by", F.try_divide(added(F.col("_parts.v")), F.col("_n")).alias("_mean"))


def voiced(frames: DataFrame, value: str, context: int, share: float, threshold: float, scale: float, by: str = "stream", block: int = BLOCK) -> DataFrame:
    """Adds hot and voiced: a frame is hot above threshold + scale * mean, voiced if enough frames around it are hot.

    Around are the `context` frames before it, itself, and context - 1 after it; frames are numbered without gaps.
    """
    level = ordered_means(frames, value, by).select("_by", (F.lit(threshold) + scale * F.col("_mean")).alias("_level"))
    out = frames.join(level, F.col(by).eqNullSafe(F.col("_by"))).withColumn("hot", (F.col(value) > F.col("_level")).cast("int")).drop("_by", "_level")
    around = Window.partitionBy(by, "_block").orderBy("frame").rowsBetween(-context, context - 1)
    out = with_halo(out, "frame", context, max(context - 1, 0), block).withColumn("voiced", F.sum("hot").over(around) >= F.count("*").over(around) * share)
    return without_halo(out, "frame", block)


def runs(frames: DataFrame, flag: str, by: str = "stream", idx: str = "frame", block: int = BLOCK) -> DataFrame:
    """stream, first, end (exclusive) and the flag of each longest run of equal flags."""
    marked = previous(frames.select(by, idx, flag), flag, "_last", by, idx, block)
    marked = marked.withColumn("_changed", F.coalesce((F.col(flag) != F.col("_last")).cast("int"), F.lit(1)))
    marked = running(marked, "_changed", "_run", by, idx, block)
    return marked.groupBy(by, "_run", flag).agg(F.min(idx).alias("first"), (F.max(idx) + 1).alias("end")).drop("_run")


def folds(df: DataFrame, k: int, idx: str = "frame", by: str | None = None) -> DataFrame:
    """Adds fold (from 0): k contiguous parts, the first n mod k of which have a row more.

    The rows are numbered without gaps, so a fold is arithmetic on the number and on n; nothing is sorted.
    """
    if by is None:
        df = df.join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    else:
        df = beside(df, staged(df.groupBy(by).agg(F.count("*").alias("_n")), "lengths"), [by])
    short, more = F.floor(F.col("_n") / k), F.col("_n") % k
    border = more * (short + 1)
    fold = F.when(F.col(idx) < border, F.floor(F.col(idx) / (short + 1))).otherwise(more + F.floor((F.col(idx) - border) / F.greatest(short, F.lit(1))))
    return df.withColumn("fold", fold.cast("bigint")).drop("_n")


def utterances(df: DataFrame, by: str, length: int = 30, idx: str = "frame", block: int = 4096) -> DataFrame:
    """Adds utterance and place, both from 0: each group's rows in the order of idx (whole numbers), `length` at a time.

    Rows are numbered within blocks of idx, after the counts of the group's blocks before, so no group is one task.
    """
    rows = df.withColumn("_block", F.floor(F.col(idx) / block))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_b")) - F.col("_n")
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_b")).agg(F.count("*").alias("_n")).select("_by", "_b", before.alias("_before"))
    k = F.col("_before") + F.row_number().over(Window.partitionBy(by, "_block").orderBy(idx)) - 1
    found = rows.join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b"))).withColumn("_k", k)
    return found.withColumns({"utterance": F.floor(F.col("_k") / length), "place": F.col("_k") % length}).drop("_block", "_b", "_by", "_before", "_k")


def rotated(df: DataFrame, by_rows: int, n: Column, idx: str = "idx") -> DataFrame:
    """A circular shift: what was at position r comes first."""
    return df.withColumn(idx, F.pmod(F.col(idx) - by_rows, n))


def blocks(df: DataFrame, size: int, idx: str = "idx", by: str = "stream", value: str = "v") -> DataFrame:
    """stream, block, block_values of each full block of `size` samples; an incomplete tail waits."""
    b = F.floor(F.col(idx) / size).cast("bigint").alias("block")
    rows = F.transform(F.array_sort(F.collect_list(F.struct(idx, value))), lambda s: s[value])
    return df.groupBy(by, b).agg(rows.alias("block_values")).where(F.size("block_values") == size)


def overlap_added(frames: DataFrame, hop: int, by: str = "stream") -> DataFrame:
    """stream, idx, v from frame, offset, y and w: the sum of the frames' samples over the sum of their weights, 0 where that is 0."""
    placed = frames.withColumn("idx", F.col("frame") * hop + F.col("offset"))
    sums = placed.groupBy(by, "idx").agg(F.sum("y").alias("y"), F.sum("w").alias("w"))
    return sums.select(by, "idx", F.when(F.abs("w") > 1e-12, F.col("y") / F.when(F.abs("w") > 1e-12, F.col("w"))).otherwise(0.0).alias("v"))


def stamps_filled(df: DataFrame, srate: float, by: str = "stream", block: int = BLOCK) -> DataFrame:
    """Adds filled: the stamp, or the last one before it plus a sample's time for each row since."""
    found = last_known(df, F.when(F.col("stamp").isNotNull(), F.struct("stamp", "idx")), "_last", by, "idx", block)
    return found.withColumn("filled", F.col("_last.stamp") + (F.col("idx") - F.col("_last.idx")) / srate).drop("_last")


def dejittered(df: DataFrame, gap: float, by: str = "stream", at: str = "t", samples: float = 0, srate: float | None = None, block: int = BLOCK) -> DataFrame:
    """Adds segment and smooth: stamps are cut where a gap is larger, and each segment's are put on its least-squares line.

    A gap is larger than `gap` seconds and, at a known rate, than the time of so many samples.  A segment of one
    row keeps its stamp.  Rows of a segment share nothing with the next.
    """
    most = max(gap, samples / srate) if srate else gap
    marked = previous(df, at, "_last", by, "idx", block)
    marked = marked.withColumn("_cut", F.coalesce((F.col(at) - F.col("_last") > most).cast("bigint"), F.lit(0))).drop("_last")
    marked = running(marked, "_cut", "segment", by, "idx", block).drop("_cut")
    i, t = F.col("idx").cast("double"), F.col(at)
    lines = marked.groupBy(F.col(by).alias("_by"), F.col("segment").alias("_s")).agg(F.avg(i).alias("_i"), F.avg(t).alias("_t"), F.coalesce(F.try_divide(F.covar_pop(t, i), F.var_pop(i)), F.lit(0.0)).alias("_slope"))
    out = marked.join(lines, F.col(by).eqNullSafe(F.col("_by")) & (F.col("segment") == F.col("_s")))
    return out.withColumn("smooth", F.col("_t") + F.col("_slope") * (i - F.col("_i"))).drop("_by", "_s", "_i", "_t", "_slope")


def effective_rate(smoothed: DataFrame, srate: float, by: str = "stream") -> DataFrame:
    """stream and rate from the rows of dejittered(): samples over seconds of all segments of two samples or more, each with a sample's time at its end; 0 without any."""
    spans = smoothed.groupBy(by, "segment").agg(F.count("*").alias("_n"), (F.max_by("smooth", "idx") - F.min_by("smooth", "idx") + 1 / srate).alias("_s"))
    some = F.col("_n") > 1
    return spans.groupBy(by).agg(F.coalesce(F.try_divide(F.sum(F.when(some, F.col("_n"))), F.sum(F.when(some, F.col("_s")))), F.lit(0.0)).alias("rate"))
