"""Windows along a single long stream, in blocks: the same as over the whole stream, and no block is the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.operators import blocks, clock, frames, joins


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(3)
    n = 2000
    v, flag = rng.normal(size=n), np.repeat(rng.random(250) < 0.5, 8)
    t = np.cumsum(0.01 + 0.001 * rng.random(n) + 3.0 * (rng.random(n) < 0.004))
    stamp = np.where(rng.random(n) < 0.02, t, np.nan)
    rows = [(None, k, float(v[k]), bool(flag[k]), float(t[k]), float(stamp[k]) if stamp[k] == stamp[k] else None) for k in range(n)]
    df = spark.createDataFrame(rows, "stream string, frame bigint, v double, flag boolean, t double, stamp double").withColumn("idx", F.col("frame"))
    return df, v, flag, t, stamp


def test_stacked_and_voiced(stream):
    df, v, *_ = stream
    got = {r["frame"]: r for r in frames.stacked(df, "v", order=2, step=5, block=16).collect()}
    assert len(got) == len(v)
    for k in range(len(v)):
        assert got[k]["features"] == [float(v[k - s]) if k >= s else 0.0 for s in (10, 5, 0)]
    got = {r["frame"]: r for r in frames.voiced(df, "v", 5, 0.4, 0.0, 1.0, block=16).collect()}
    hot = (v > v.mean()).astype(int)
    for k in range(len(v)):
        around = hot[max(0, k - 5) : k + 5]
        assert got[k]["hot"] == hot[k] and got[k]["voiced"] == (around.sum() >= len(around) * 0.4)


def test_runs_stamps_and_segments(stream):
    df, _, flag, t, stamp = stream
    n = len(flag)
    want, begin = [], 0
    for k in range(1, n + 1):
        if k == n or flag[k] != flag[begin]:
            want.append((begin, k, bool(flag[begin])))
            begin = k
    assert sorted((r["first"], r["end"], r["flag"]) for r in frames.runs(df, "flag", block=16).collect()) == want
    got = {r["idx"]: r["filled"] for r in frames.stamps_filled(df, 100.0, block=16).collect()}
    last = None
    for k in range(n):
        last = (stamp[k], k) if stamp[k] == stamp[k] else last
        assert got[k] is None if last is None else got[k] == pytest.approx(last[0] + (k - last[1]) / 100)
    rows = sorted(frames.dejittered(df, 1.0, samples=50, srate=100.0, block=16).collect(), key=lambda r: r["idx"])
    segment = np.concatenate([[0], np.cumsum(np.diff(t) > 1.0)])
    assert [r["segment"] for r in rows] == segment.tolist()
    counts, seconds = 0, 0.0
    for s in np.unique(segment):
        k = np.flatnonzero(segment == s)
        line = np.polyval(np.polyfit(k - k.mean(), t[k], 1), k - k.mean()) if len(k) > 1 else t[k]
        assert np.allclose([rows[i]["smooth"] for i in k], line, atol=1e-6)
        if len(k) > 1:
            counts, seconds = counts + len(k), seconds + line[-1] - line[0] + 0.01
    rate = frames.effective_rate(frames.dejittered(df, 1.0, block=16), 100.0).first()["rate"]
    assert rate == pytest.approx(counts / seconds, rel=1e-6)


def test_nearest_within_ranges_of_times(spark, stream):
    _, _, _, t, _ = stream
    rng = np.random.default_rng(4)
    probes = rng.uniform(t[0] - 5, t[-1] + 5, 300)
    g = spark.createDataFrame([("s", float(x)) for x in t], "stream string, t double")
    p = spark.createDataFrame([("s", float(x)) for x in probes], "stream string, t double")
    for r in joins.nearest(p, g).collect():
        assert abs(r["hit"] - r["t"]) == np.abs(t - r["t"]).min()


def test_ranges_of_a_long_clock(spark):
    t = np.concatenate([np.arange(500) * 5.0, np.arange(500) * 5.0 - 9000])
    offset = np.concatenate([2 + t[:500] * 1e-5, 400 + t[500:] * 1e-5])
    df = spark.createDataFrame([("s", k, float(a), float(b)) for k, (a, b) in enumerate(zip(t, offset))], "stream string, seq bigint, t double, offset double")
    got = {r["seq"]: r["range"] for r in clock.ranges(df).collect()}
    assert got == {k: int(k >= 500) for k in range(1000)}
    lines = {r["range"]: r for r in clock.fitted(clock.ranges(df)).collect()}
    assert lines[0]["slope"] == pytest.approx(1e-5, rel=1e-6) and lines[1]["intercept"] == pytest.approx(400, rel=1e-6) and lines[1]["start"] == -9000


def test_no_block_has_more_rows_than_its_numbers_and_halo(stream):
    df, *_ = stream
    sizes = blocks.with_halo(df, "frame", 10, 3, 64).groupBy("stream", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 64 + 13
    kept = blocks.without_halo(blocks.with_halo(df, "frame", 10, 3, 64), "frame", 64)
    assert kept.count() == df.count()
    sums = blocks.running(df.select("stream", "frame", F.lit(1).alias("one")), "one", "n", "stream", "frame", 64).collect()
    assert all(r["n"] == r["frame"] + 1 for r in sums)
