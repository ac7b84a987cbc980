"""Clock correction: ranges between resets, and a robust line through each range's offsets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import numbers, whole
from .blocks import previous, running
from .selection import medians
from .staging import sized, staged

EPS = 2.220446049250313e-16


def huber_lines(t: np.ndarray, y: np.ndarray, starts: np.ndarray, tolerance: float = 1e-12, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts, slopes) that minimise the Huber loss of residuals around 1 in each range of rows, from its start to the next.

    Weighted least squares, where a residual beyond 1 weighs as much less as it is larger; all ranges are
    weighed together, and a range whose line no longer moves is left out of the next rounds.
    """
    size = np.diff(np.append(starts, len(t)))
    lines = np.zeros((2, len(starts)))
    left = np.arange(len(starts))
    rows, w = np.arange(len(t)), np.ones(len(t))
    for _ in range(rounds):
        if not len(left):
            break
        own, at = np.repeat(np.arange(len(left)), size[left]), np.cumsum(size[left]) - size[left]
        x, z = t[rows], y[rows]
        sums = np.add.reduceat(np.stack([w, w * x, w * z]), at, axis=1)
        mx, mz = sums[1] / sums[0], sums[2] / sums[0]
        dx = x - mx[own]
        over, under = np.add.reduceat(np.stack([w * dx * (z - mz[own]), w * dx * dx]), at, axis=1)
        slope = np.where(under > 0, over / np.where(under > 0, under, 1.0), 0.0)
        new = np.stack([mz - slope * mx, slope])
        moved = np.abs(new - lines[:, left]).max(0) > tolerance * (1 + np.abs(new).max(0))
        lines[:, left] = new
        w = 1 / np.maximum(1.0, np.abs(z - new[0][own] - slope[own] * x))
        rows, w, left = rows[moved[own]], w[moved[own]], left[moved]
    return lines[0], lines[1]


def ranges(offsets: DataFrame, by: str = "stream", stds: float = 5, seconds: float = 5, offset_stds: float = 10, offset_seconds: float = 1) -> DataFrame:
    """offsets (stream, t, offset, in the order of seq) with range: the measurements between two resets of the clock.

    A reset is a jump both in the time between measurements, or a step back in time, and in the offset,
    far beyond the medians.
    """
    d = previous(offsets.withColumn("_now", F.struct("t", "offset")), "_now", "_last", by, "seq")
    d = d.withColumns({"_dt": F.col("t") - F.col("_last.t"), "_do": F.abs(F.col("offset") - F.col("_last.offset"))}).drop("_now", "_last")
    d = staged(d, "steps")
    middle = every = d.select(by).distinct()
    middle = staged(every.join(medians(d, [by], _mt="_dt", _mo="_do"), by, "left"), "middle")
    d = d.join(sized(middle), by)
    spread = medians(d, [by], _st=F.abs(F.col("_dt") - F.col("_mt")), _so=F.abs(F.col("_do") - F.col("_mo")))
    d = d.join(sized(staged(every.join(spread, by, "left"), "spread")), by).withColumns({c: F.col(c) + EPS for c in ("_st", "_so")})

    def beyond(x: str, m: str, s: str, most_stds: float, most: float) -> Column:
        off = F.col(x) - F.col(m)
        return (off / F.col(s) > most_stds) & (off > most)

    glitch = ((F.col("_dt") < 0) | beyond("_dt", "_mt", "_st", stds, seconds)) & beyond("_do", "_mo", "_so", offset_stds, offset_seconds)
    d = d.withColumn("_cut", F.coalesce(glitch.cast("bigint"), F.lit(0)))
    return running(d, "_cut", "range", by, "seq").select(*offsets.columns, "range")


#: Measurements of a range that a task fits by itself.
WHOLE = 1 << 20


def fitted(ranged: DataFrame, by: str = "stream", winsor: float = 1e-4, whole_: int = WHOLE) -> DataFrame:
    """stream, range, start (its first time), intercept and slope of the offsets; a single measurement is a constant.

    A task fits many ranges of up to `whole_` measurements together; larger ones are fitted by sums over all tasks.
    """
    keys = [by, "range"]
    rows = ranged.select(by, F.col("range").cast("bigint").alias("range"), "seq", F.col("t").cast("double").alias("t"), F.col("offset").cast("double").alias("offset"))
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min_by("t", "seq").alias("start"), F.avg("t").alias("_mid"), F.greatest(F.stddev_pop("t"), F.lit(1e-9)).alias("_wide")).where(F.col("_n") > whole_)
    large = staged(large, "large")
    if large.isEmpty():
        return _fitted_whole(rows, ranged.schema[by].dataType.simpleString(), by, winsor)
    few = large.select(F.col(by).alias("_by"), F.col("range").alias("_range"), "start", "_mid", "_wide")
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("range") == F.col("_range"))
    small = _fitted_whole(rows.join(sized(few), same, "left_anti"), ranged.schema[by].dataType.simpleString(), by, winsor)
    scaled = rows.join(sized(few), same).select(*keys, ((F.col("t") - F.col("_mid")) / F.col("_wide")).alias("x"), (F.col("offset") / winsor).alias("y"))
    lines = huber_sums(scaled, keys).join(few, same)
    slope = F.col("b") * winsor / F.col("_wide")
    return small.unionByName(lines.select(*keys, "start", (F.col("a") * winsor - slope * F.col("_mid")).alias("intercept"), slope.alias("slope")))


def huber_sums(rows: DataFrame, keys: list[str], tolerance: float = 1e-12, rounds: int = 200) -> DataFrame:
    """keys, a and b: what huber_lines() finds for rows (keys, x, y), by rounds of sums over all tasks; residuals stay where they are.

    From the better of two lines a round's sums give the next two: weighted least squares, which never makes the loss
    larger, and the line that is best if residuals stay on their side of 1, which ends the search once they do.
    A group rests when neither moves.  Only the sums of groups, a row each, come together.
    """
    same = lambda: _all(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)
    at = staged(rows.groupBy(*keys).agg(F.avg("y").alias("a")).select(*(F.col(k).alias(f"_{k}") for k in keys), F.array(F.struct("a", F.lit(0.0).alias("b"))).alias("lines"), F.lit(True).alias("moves")), "lines")
    rested = None
    for _ in range(rounds):
        r = F.col("y") - F.col("l.a") - F.col("l.b") * F.col("x")
        w, inside, sign = 1 / F.greatest(F.lit(1.0), F.abs("r")), F.abs("r") <= 1, F.signum("r")
        tried = rows.join(sized(at.select(*(f"_{k}" for k in keys), F.posexplode("lines").alias("which", "l"))), same()).withColumn("r", r)
        zero = lambda c: F.when(inside, c).otherwise(0.0)
        sums = {"loss": F.when(inside, F.col("r") * F.col("r") / 2).otherwise(F.abs("r") - 0.5), "w": w, "wx": w * F.col("x"), "wxx": w * F.col("x") * F.col("x"), "wy": w * F.col("y"), "wxy": w * F.col("x") * F.col("y"),
                "n": zero(F.lit(1.0)), "nx": zero(F.col("x")), "nxx": zero(F.col("x") * F.col("x")), "ny": zero(F.col("y")), "nxy": zero(F.col("x") * F.col("y")), "s": F.when(inside, 0.0).otherwise(sign), "sx": F.when(inside, 0.0).otherwise(sign * F.col("x"))}
        found = tried.groupBy(*keys, "which").agg(F.first("l").alias("l"), *(F.sum(c).alias(name) for name, c in sums.items()))
        best = found.groupBy(*keys).agg(F.min_by(F.struct(*found.columns[len(keys) + 1 :]), F.struct("loss", "which")).alias("m"))

        def solved(n: str, x: str, xx: str, y: Column, xy: Column) -> Column:
            det = F.col(n) * F.col(xx) - F.col(x) * F.col(x)
            flat = F.struct(F.coalesce(F.try_divide(y, F.col(n)), F.col("l.a")).alias("a"), F.lit(0.0).alias("b"))
            line = F.struct(((y * F.col(xx) - xy * F.col(x)) / det).alias("a"), ((F.col(n) * xy - F.col(x) * y) / det).alias("b"))
            return F.when(det > 1e-12 * F.col(n) * F.col(n), line).otherwise(flat)

        best = best.select(*keys, "m.*").withColumn("next", F.array(solved("n", "nx", "nxx", F.col("ny") + F.col("s"), F.col("nxy") + F.col("sx")), solved("w", "wx", "wxx", F.col("wy"), F.col("wxy"))))
        far = lambda l: F.greatest(F.abs(l["a"] - F.col("l.a")), F.abs(l["b"] - F.col("l.b"))) > tolerance * (1 + F.greatest(F.abs(F.col("l.a")), F.abs(F.col("l.b"))))  # noqa: E731, E741
        at = staged(best.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("l"), F.concat("next", F.array("l")).alias("lines"), far(F.get("next", F.lit(1))).alias("moves")), "lines")
        ends = at.where("not moves").select(*(F.col(f"_{k}").alias(k) for k in keys), "l.a", "l.b")
        rested = ends if rested is None else rested.unionByName(ends)
        at = at.where("moves")
        if at.isEmpty():
            return rested
    return rested.unionByName(at.select(*(F.col(f"_{k}").alias(k) for k in keys), "l.a", "l.b"))


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _fitted_whole(rows: DataFrame, kind: str, by: str, winsor: float) -> DataFrame:
    keys = [by, "range"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole(batches, keys):
            t, y = numbers(table, "t"), numbers(table, "offset")
            size = np.diff(np.append(begin, len(t)))
            # times are centred and scaled, which the loss does not see, for the equations' sake
            mid = np.add.reduceat(t, begin) / size
            off = t - np.repeat(mid, size)
            wide = np.maximum(np.sqrt(np.add.reduceat(off * off, begin) / size), 1e-9)
            a, b = huber_lines(off / np.repeat(wide, size), y / winsor, begin)
            slope = np.where(size > 1, b * winsor / wide, 0.0)
            intercept = np.where(size > 1, a * winsor - slope * mid, y[begin])
            first = table.take(pa.array(begin))
            yield pa.RecordBatch.from_arrays([*(first[k].combine_chunks() for k in keys), *map(pa.array, (t[begin], intercept, slope))], names=[*keys, "start", "intercept", "slope"])

    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "seq")
    return rows.mapInArrow(lines, f"`{by}` {kind}, range bigint, start double, intercept double, slope double")


def corrected(stamps: DataFrame, lines: DataFrame, by: str = "stream", at: str = "t") -> DataFrame:
    """stamps with `at` moved by the line of the range that its time falls in: the last to start before it, or else the first."""
    sorted_ = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "intercept", "slope"))).alias("_l"))  # a handful for each stream
    out = stamps.join(sorted_, by, "left")
    fit = F.coalesce(F.try_element_at(F.filter("_l", lambda x: x["start"] <= F.col(at)), F.lit(-1)), F.try_element_at("_l", F.lit(1)))
    return out.withColumn("_fit", fit).withColumn(at, F.col(at) + F.coalesce(F.col("_fit.intercept") + F.col("_fit.slope") * F.col(at), F.lit(0.0))).drop("_l", "_fit")


def synchronised(stamps: DataFrame, offsets: DataFrame, by: str = "stream", resets: bool = True) -> DataFrame:
    """Stamps in the recording computer's clock; streams without offsets stay as they are."""
    ranged = ranges(offsets, by) if resets else offsets.withColumn("range", F.lit(0).cast("bigint"))
    return corrected(stamps, fitted(ranged, by), by)
