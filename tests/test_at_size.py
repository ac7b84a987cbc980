"""What small tables do not show: groups of a single row, ties that a sum's order decides, many streams."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sonarframe.functions import filters
from sonarframe.operators import experiment, features, filtering, frames, joins, statistics, vocoder


def test_an_utterance_too_short_for_a_block_has_no_samples(spark):
    mel = [0.1 * k for k in range(16)]
    for kind, short, long in (("string", "a", "b"), ("bigint", 1, 2)):
        rows = [(short, 0, mel)] + [(long, k, mel) for k in range(3)]
        made = vocoder.griffin_lim(spark.createDataFrame(rows, f"stream {kind}, frame bigint, mel array<double>"), streaming=True)
        assert {(r["stream"], r["count"]) for r in made.groupBy("stream").count().collect()} == {(long, 320)}


def tied(seed, n=65):
    """Values of two digits, the first of which is just 0.5 above the mean, so that the order of the sum decides on which side it is."""
    cents = np.random.default_rng(seed).integers(1, 20000, n).tolist()
    cents[-1] += -(50 * n + sum(cents[1:])) % (n - 1)
    cents[0] = (50 * n + sum(cents[1:])) // (n - 1)
    assert n * (cents[0] - 50) == sum(cents)
    return [c / 100 for c in cents]


def above(values, order):
    total = 0.0
    for k in order:
        total += values[k]
    return values[0] > 0.5 + total / len(values)


def test_a_tie_with_the_mean_is_decided_by_the_sum_in_order(spark):
    found = [x for x in map(tied, range(60)) if above(x, range(65)) != above(x, reversed(range(65)))]
    assert len(found) > 3
    rows = [(s, k, v) for s, x in enumerate(found) for k, v in enumerate(x)][::-1]
    df = spark.createDataFrame(rows, "stream bigint, frame bigint, v double")
    for dealt in (df.coalesce(1), df.repartition(3, "frame")):
        hot = frames.voiced(dealt, "v", 5, 0.6, 0.5, 1.0).where("frame = 0").select("stream", "hot").collect()
        assert {r["stream"]: r["hot"] for r in hot} == {s: int(above(x, range(65))) for s, x in enumerate(found)}


def test_means_of_blocks_nulls_and_streams_without_values(spark):
    rows = [(1, k, float(k)) for k in range(10)] + [(1, 10, None), (2, 0, None), (None, 0, 3.0)]
    df = spark.createDataFrame(rows, "stream bigint, frame bigint, v double")
    assert {tuple(r) for r in frames.ordered_means(df, "v", "stream", block=4).collect()} == {(1, 4.5), (2, None), (None, 3.0)}


def any_cuts(monkeypatch):
    """Quantiles are other ones each time they are worked out, as they are where tasks' summaries meet in any order."""

    @F.pandas_udf("array<double>")
    def drawn(v: pd.Series) -> list:
        return np.sort(np.random.default_rng().choice(v.to_numpy(dtype=float), 5)).tolist()

    monkeypatch.setattr(F, "percentile_approx", lambda value, *_: drawn(F.col(value).cast("double")))


def test_ranks_whatever_the_quantiles(spark, monkeypatch):
    any_cuts(monkeypatch)
    df = spark.createDataFrame([(k % 2, float(k * 7919 % 1009)) for k in range(2018)], "bin bigint, v double")
    for b in range(2):
        found = [r["rank"] for r in statistics.ranks(df, "v", "bin").where(F.col("bin") == b).orderBy("v").collect()]
        assert found == counted_ranks([k * 7919 % 1009 for k in range(b, 2018, 2)])


def counted_ranks(values):
    """Average ranks by counting."""
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in sorted(values)]


def test_nearest_whatever_the_quantiles(spark, monkeypatch):
    any_cuts(monkeypatch)
    grid = [(0, float(k * 7919 % 1009)) for k in range(0, 1009, 3)]
    probes = [(0, k + 0.25) for k in range(1009)]
    made = joins.nearest(spark.createDataFrame(probes, "stream bigint, t double"), spark.createDataFrame(grid, "stream bigint, t double"))
    assert {r["t"]: r["hit"] for r in made.collect()} == {t: min((g for _, g in grid), key=lambda g: (abs(g - t), g)) for _, t in probes}


def test_first_states_of_all_streams_are_made_together(monkeypatch):
    stages = [(s, k) for s, k in zip(filters.high_gamma(1024.0), ("cold", "rest", "warm"), strict=True)]
    heads = np.random.default_rng(0).normal(size=500)
    one_by_one = np.concatenate([filtering._begin(stages, 41, heads[k : k + 1]) for k in range(500)], axis=1)
    calls, run = [], filters.run
    monkeypatch.setattr(filters, "run", lambda *a, **b: calls.append(1) or run(*a, **b))
    assert np.allclose(filtering._begin(stages, 41, heads), one_by_one, rtol=1e-12, atol=1e-12)
    assert len(calls) == len(stages) + 1


def test_streams_of_no_full_chunk_and_of_many(spark):
    """Against a run over the whole stream, for many streams in a task."""
    sections, rng = filters.butterworth(2, "low", (40.0,), 250.0), np.random.default_rng(1)
    streams = {s: rng.normal(size=n) for s, n in enumerate([1, 7, 8, 9, 16, 17, 40, 3, 64])}
    df = spark.createDataFrame([(s, k, float(v)) for s, x in streams.items() for k, v in enumerate(x)], "stream bigint, idx bigint, v double").coalesce(1)
    got = {(r["stream"], r["idx"]): r["v"] for r in filtering.filtered(df, sections, chunk=8).collect()}
    for s, x in streams.items():
        want = filters.run(sections, x[:, None], filters.cold(sections, x[:1]))[0][:, 0]
        assert np.allclose([got[s, k] for k in range(len(x))], want, atol=1e-12)


def test_features_do_not_filter_for_the_lengths_of_streams(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(frames, "lengths", lambda samples, *a, f=frames.lengths: asked.append(samples) or f(samples, *a))
    df = spark.createDataFrame([(s, k, float(k % 7)) for s in range(2) for k in range(80)], "stream bigint, idx bigint, v double")
    for make in (features.neural, features.neural_batch):
        make(df, features.Options(stack=False)).collect()
    assert len(asked) == 2 and not any("MapInArrow" in d._jdf.queryExecution().toString() for d in asked)


def test_features_chosen_outside_of_folds_are_those_of_the_repeated_rows(spark, monkeypatch):
    rng, k = np.random.default_rng(3), 4
    rows = [(2 * (r // 60) * k + r % k, r % k, rng.integers(0, 9, 6).astype(float).tolist(), rng.normal(size=2).tolist()) for r in range(120)]
    df = spark.createDataFrame(rows, "cell bigint, fold bigint, x array<double>, y array<double>")
    parts = df.crossJoin(spark.range(k).withColumnRenamed("id", "p")).where("p <> fold").withColumn("cell", F.expr("cell - fold + p"))
    assert experiment.select_features_outside(df, 3, k) == experiment.select_features_by(parts, "cell", 3)
    asked = []
    monkeypatch.setattr(experiment, "select_features_by", lambda *a, **b: asked.append(a))
    frames_ = spark.createDataFrame([(r, [float(v) for v in rng.normal(size=3)], [float(v) for v in rng.normal(size=2)]) for r in range(40)], "frame bigint, x array<double>, y array<double>")
    assert experiment.reconstructed(frames_, "x", "y", 4, 3, features=2).count() == 40 and not asked
