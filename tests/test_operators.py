"""Operators on small tables: ties, gaps, empty groups, and streams against their batch twins."""

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.functions import filters, timing, udf
from sonarframe.operators import audio, clock, dtw, experiment, features, filtering, frames, joins, quantize, select, statistics
from sonarframe.plans import models
from sonarframe.sources import labels, playback, recordings, replay
from sonarframe.sources.views import wide_frames
from sonarframe.streaming import features as streaming


def nearest_position(grid, t):
    at = bisect.bisect_right(grid, t)
    around = [k for k in (at - 1, at) if 0 <= k < len(grid)]
    return min(around, key=lambda k: (abs(grid[k] - t), k))


def test_nearest_takes_the_earlier_of_ties(spark):
    grid, probes = [0.0, 2.0, 3.0, 8.0], [1.0, 2.5, 9.0, -4.0, 3.0]
    g = spark.createDataFrame([("s", t) for t in grid], "stream string, t double")
    p = spark.createDataFrame([("s", t) for t in probes] + [("none", 1.0)], "stream string, t double")
    got = {(r["stream"], r["t"]): r["hit"] for r in joins.nearest(p, g).collect()}
    assert {t: got["s", t] for t in probes} == {t: grid[nearest_position(grid, t)] for t in probes}
    assert got["none", 1.0] is None


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(0)
    return {"a": rng.normal(size=700), "b": rng.normal(size=333), "c": rng.normal(size=3)}


@pytest.fixture(scope="module")
def samples(spark, signals):
    return spark.createDataFrame([(s, k, float(v)) for s, x in signals.items() for k, v in enumerate(x)], "stream string, idx bigint, v double")


@pytest.mark.parametrize("start", ["rest", "cold", "warm"])
def test_chunked_filter_equals_one_run(samples, signals, start):
    s = filters.butterworth(8, "pass", (70, 170), 1024)
    got = filtering.filtered(samples, s, start=start, zeros=41, chunk=100).orderBy("stream", "idx").collect()
    for name, x in signals.items():
        state = {"rest": np.zeros((len(s), 2, 1)), "cold": filters.cold(s, x[:1]), "warm": filters.warm(s, 1, 41)}[start]
        want, _ = filters.run(s, x[:, None], state)
        assert np.allclose([r["v"] for r in got if r["stream"] == name], want[:, 0], atol=1e-9)


def test_stream_equals_batch_features(spark, samples, signals):
    o = features.Options()
    rows = features.neural(samples, o).orderBy("stream", "frame").collect()
    for name, x in signals.items():
        want = streaming.Features(o).feed(x)
        own = [r for r in rows if r["stream"] == name]
        assert [r["frame"] for r in own] == [w[0] for w in want]
        assert np.allclose([r["energy"] for r in own], [w[1] for w in want], atol=1e-8)
        assert np.allclose([r["features"] for r in own], [w[2] for w in want], atol=1e-8)


def run(stream, tmp_path, name, mode="append"):
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-ck").option("path", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.parquet(f"{tmp_path}/{name}"), q


def test_streaming_query_equals_batch(spark, samples, signals, tmp_path):
    path = str(tmp_path / "chunks")
    replay.write(samples, path, 100)
    schema = "stream string, idx bigint, v double, chunk bigint"
    o = features.Options()
    got, q = run(streaming.neural(replay.read(spark, path, schema), o), tmp_path, "out")
    rows = got.orderBy("stream", "frame").collect()
    for name, x in signals.items():
        want = streaming.Features(o).feed(x[: len(x) // 100 * 100])
        own = [r for r in rows if r["stream"] == name]
        assert [r["frame"] for r in own] == [w[0] for w in want]
        assert np.allclose([r["features"] for r in own] or 0, [w[2] for w in want] or 0, atol=1e-8)
    assert timing.batch_seconds(q)


def test_streaming_blocks(spark, samples, signals, tmp_path):
    path = str(tmp_path / "chunks")
    replay.write(samples, path, 50)
    got, _ = run(streaming.reblocked(replay.read(spark, path, "stream string, idx bigint, v double, chunk bigint"), 64), tmp_path, "out")
    own = [v for r in got.where("stream = 'a'").orderBy("block").collect() for v in r["block_values"]]
    assert own == signals["a"][: 700 // 64 * 64].tolist()


def test_streaming_vocoder_keeps_its_state(spark, tmp_path):
    from sonarframe.operators import vocoder

    mels = np.random.default_rng(0).normal(size=(20, 16))
    rows = [("s", k, m.tolist(), k // 5) for k, m in enumerate(mels)]
    df = spark.createDataFrame(rows, "stream string, frame bigint, mel array<double>, chunk bigint")
    df.repartition("chunk").write.partitionBy("chunk").parquet(f"{tmp_path}/in")
    got, _ = run(streaming.vocoded(replay.read(spark, f"{tmp_path}/in", df.schema), mels=16), tmp_path, "out")
    wave = [v for r in got.orderBy("frame").collect() for v in r["wave"]]
    own = vocoder.Stream(mels=16, seed=vocoder.key_seed("s", 0))
    assert wave == np.concatenate([own.feed(m) for m in mels]).tolist()


def test_ranks_with_ties_and_a_frequent_value(spark):
    rng = np.random.default_rng(0)
    values = [*rng.integers(0, 50, 500).tolist(), *[7] * 300]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", None)], "bin string, v double")
    got = [(r["v"], r["rank"]) for r in statistics.ranks(df, "v", "bin").where("bin = 'g'").collect()]
    below, same = (lambda v: sum(x < v for x in values)), (lambda v: values.count(v))
    assert len(got) == len(values) and all(r == below(v) + (same(v) + 1) / 2 for v, r in got)
    assert [r["rank"] for r in statistics.ranks(df, "v", "bin").where("bin = 'h'").orderBy("v").collect()] == [None, 1.0]


def test_rank_test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 40), rng.integers(1, 11, 30)
    df = spark.createDataFrame([("x", float(v), True) for v in a] + [("x", float(v), False) for v in b], "bin string, v double, first boolean")
    r = statistics.mann_whitney(df, "v", F.col("first"), "bin").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u1"] == u and r["u1"] + r["u2"] == 1200 and 0 < r["p"] < 0.05


def test_normal_tail(spark):
    p = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (1.959964,), (4.0,)], "z double").select(statistics.two_sided(F.col("z"))).collect()]
    assert p == pytest.approx([1.0, 0.3173105, 0.05, 6.334e-5], rel=1e-3)


def test_correlation_of_what_does_not_vary(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 3.0), (1, 1.0, 1.0), (1, 2.0, 2.0)], "bin int, a double, b double")
    assert {r["bin"]: r["r"] for r in statistics.by_bin(df, "a", "b").collect()} == {0: None, 1: pytest.approx(1.0)}


def test_quantiser_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 1.5)], "v double")
    level = quantize.level("v", F.array(F.lit(0.0), F.lit(1.0)))
    assert [r[0] for r in df.select(level).collect()] == [0, 0, 1, 1, 0]


def test_median_cut(spark):
    df = spark.createDataFrame([(0, float(v)) for v in range(8)] + [(1, 5.0)] * 4, "bin int, v double")
    books = {r["bin"]: r for r in quantize.median_cut_codebook(df, 4).collect()}
    assert len(books[0]["borders"]) == 4 and books[0]["borders"][-1] == 7.0 and books[0]["borders"] == sorted(books[0]["borders"])
    assert books[1]["borders"] == [5.0] and books[1]["medians"] == [5.0]


def test_dejitter_and_runs(spark):
    rows = [("s", k, k * 0.1 + (0.01 if k % 2 else 0) + (100 if k >= 5 else 0)) for k in range(10)]
    got = frames.dejittered(spark.createDataFrame(rows, "stream string, idx bigint, t double"), 1.0).orderBy("idx").collect()
    assert [r["segment"] for r in got] == [0] * 5 + [1] * 5
    steps = np.diff([r["smooth"] for r in got[:5]])
    assert np.allclose(steps, steps[0])
    flags = spark.createDataFrame([("s", k, f) for k, f in enumerate([True, True, False, True])], "stream string, frame bigint, f boolean")
    assert sorted((r["first"], r["end"], r["f"]) for r in frames.runs(flags, "f").collect()) == [(0, 2, True), (2, 3, False), (3, 4, True)]


def test_folds_of_103(spark):
    got = frames.folds(spark.range(103).withColumnRenamed("id", "frame"), 10).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in got] == [11, 11, 11] + [10] * 7


def test_clock_that_starts_anew(spark):
    rows = [("s", k, 5.0 * k, 2.0 + 1e-4 * 5 * k) for k in range(40)] + [("s", 40 + k, 5.0 * k - 10_000, 600.0) for k in range(40)]
    o = spark.createDataFrame(rows, "stream string, seq bigint, t double, offset double")
    ranged = clock.ranges(o)
    assert [r["range"] for r in ranged.orderBy("seq").collect()] == [0] * 40 + [1] * 40
    lines = {r["range"]: r for r in clock.fitted(ranged).collect()}
    assert lines[0]["slope"] == pytest.approx(1e-4, abs=1e-8) and lines[0]["intercept"] == pytest.approx(2, abs=1e-4)
    stamps = spark.createDataFrame([("s", 50.0), ("s", -9950.0), ("other", 1.0)], "stream string, t double")
    got = sorted(r["t"] for r in clock.synchronised(stamps, o).collect())
    assert got == pytest.approx([-9350.0, 1.0, 52.005], abs=1e-3)


def test_audio_is_rescaled(spark):
    df = spark.createDataFrame([(0, 16384.0), (1, -32768.0)], "idx int, v double")
    assert [r["v"] for r in audio.rescaled(df, integer=True).orderBy("idx").collect()] == [0.5, -1.0]
    assert [r["v"] for r in audio.rescaled(df, integer=False).orderBy("idx").collect()] == [0.5, -1.0]


def test_voice_activity_of_loud_and_quiet(spark):
    sr, rng = 1600, np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=sr) * 1, rng.normal(size=sr) * 8000, rng.normal(size=sr) * 1])
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "stream string, idx bigint, v double")
    got = {r["frame"]: r["voiced"] for r in audio.voiced_from_wave(df, sr, threshold=4.0).collect()}
    assert sum(got[k] for k in range(110, 190)) == 80 and sum(got[k] for k in range(80)) == 0


def test_log_mels_have_a_frame_a_shift(spark):
    x = np.sin(np.arange(1600))
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "stream string, idx bigint, v double")
    got = audio.log_mels(df, 1600, 0.05, 0.01, 8).orderBy("frame").collect()
    assert [r["frame"] for r in got] == list(range(100)) and {len(r["mel"]) for r in got} == {8}


def test_reconstruction_beats_chance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = x[:, :2] * 2 + rng.normal(size=(300, 2)) * 0.1
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "frame bigint, x array<double>, y array<double>")
    real = experiment.correlations(experiment.reconstructed(df, "x", "y", 3, features=4)).agg(F.avg("r")).first()[0]
    chance = experiment.correlations(experiment.reconstructed(df, "x", "y", 3, run=1)).agg(F.avg("r")).first()[0]
    assert real > 0.8 and abs(chance) < 0.3


def test_selection_of_signals(spark):
    df = spark.createDataFrame([("s", k, lab) for k, lab in enumerate(["x", "a", "x", "b", "x"])] + [("t", 0, "x")], "stream string, idx bigint, label string")
    assert sorted(r["idx"] for r in select.crop_between(df, "a", "b").collect()) == [1, 2]
    assert sorted(r["idx"] for r in select.crop_between(df, "b", "a").collect()) == [3, 4]


def test_markers_and_label_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("2024-01-01,100.125,start;tree\n2024-01-01,103.0,end;tree\n")
    got = labels.trial_starts(labels.read_markers(spark, str(tmp_path / "m.csv")), 100.0, 100).collect()
    assert [(r["word"], r["seconds"], r["first"]) for r in got] == [("tree", 0.12, 12)]
    runs = spark.createDataFrame([("s", 0, 150, True), ("s", 150, 200, False)], "stream string, first bigint, end bigint, voiced boolean")
    labels.write_lines(labels.interval_lines(runs, "voiced"), str(tmp_path / "lab"))
    text = "".join(p.read_text() for p in (tmp_path / "lab" / "stream=s").glob("*.txt"))
    assert text == "0.00\t1.50\t1\n1.50\t2.00\t0\n"


def test_small_helpers(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "idx bigint, x array<double>")
    assert [r["x"] for r in recordings.without_channels(df, [1]).collect()] == [[1.0, 3.0]]
    assert recordings.long(df).count() == 3 and recordings.channel_names(2) == ["ch_000", "ch_001"]
    assert udf.on_chunks(df.select("idx"), lambda p: p + 1, "idx bigint").first()["idx"] == 1
    with pytest.raises(ValueError):
        recordings.read_signal(spark, "x.txt")
    with pytest.raises(ValueError):
        playback.routed(df, "up", "idx")
    df.write.parquet(str(tmp_path / "a.parquet"))
    assert recordings.read_signal(spark, str(tmp_path / "a.parquet")).count() == 1
    assert timing.benchmark(lambda: 3)() == 3


def test_all_frames_are_warped(spark, sf_dir):
    """Each label's frames, thirty at a time, against the next label's of the same number, on plain arrays."""
    of = {}
    for r in sorted(wide_frames(spark, sf_dir).collect(), key=lambda r: r["frame"]):
        of.setdefault(r["y"], []).append(r["x"])
    want = {}
    for y in range(10):
        a, b = (np.array(of.get(k, [])) for k in (y, (y + 1) % 10))
        for u in range(-(-max(len(a), len(b)) // 30)):
            q, r = a[30 * u : 30 * u + 30], b[30 * u : 30 * u + 30]
            n = min(len(q), len(r))
            want[y, u] = dtw.correlation(r[:n][dtw.warping(dtw.path(q[:n], r[:n]), n)], q[:n]) if n > 1 else float("nan")
    got = {(r["pair"], r["utterance"]): r["r"] for r in models.dtw_corr(spark, sf_dir).collect()}
    assert len(want) > 10 and got.keys() == want.keys()
    assert all(got[k] is None if np.isnan(v) else got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
