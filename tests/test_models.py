"""Alignment in little memory, models from stored sums, activation patterns."""

import tracemalloc

import numpy as np
import pytest

from sonarframe.operators import dtw, experiment, features, lda, statistics


def by_table(query, reference):
    """The alignment with the step of every cell kept."""
    n, m = len(query), len(reference)
    cost = np.sqrt(((query[:, None, :] - reference[None, :, :]) ** 2).sum(2))
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    step = np.zeros((n + 1, m + 1), dtype=int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ways = (total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
            step[i, j] = int(np.argmin(ways))
            total[i, j] = ways[step[i, j]] + cost[i - 1, j - 1]
    out, i, j = [], n, m
    while i and j:
        out.append((i - 1, j - 1))
        k = step[i, j]
        i, j = i - (k != 2), j - (k != 1)
    return out[::-1]


@pytest.mark.parametrize("leaf, fan", [(2, 2), (7, 3), (512, 16)])
def test_alignments_equal_those_of_a_whole_table(leaf, fan):
    rng = np.random.default_rng(leaf)
    for n, m in ((1, 1), (1, 9), (9, 1), (30, 30), (57, 23), (23, 57), (64, 64)):
        for values in (rng.normal(size=(n + m, 2)), rng.integers(0, 3, (n + m, 1)).astype(float), np.zeros((n + m, 1))):  # ties, and nothing but ties
            q, r = values[:n], values[n:]
            assert dtw.path(q, r, leaf, fan) == by_table(q, r)
    assert dtw.path(np.zeros((0, 1)), np.zeros((3, 1))) == []


def test_long_alignments_take_little_memory():
    rng = np.random.default_rng(0)
    n = 6000
    q = np.cumsum(rng.normal(size=(n, 1)), axis=0)
    r = q[np.sort(rng.integers(0, n, n))] + 0.01 * rng.normal(size=(n, 1))
    tracemalloc.start()
    found = dtw.path(q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n / 4  # bytes; a table of steps has n * n
    assert found[0] == (0, 0) and found[-1] == (n - 1, n - 1)
    steps = np.diff(np.array(found), axis=0)
    assert {tuple(s) for s in steps.tolist()} <= {(1, 1), (1, 0), (0, 1)}
    assert found == dtw.path(q, r, leaf=3000, fan=4)
    straight = np.abs(q - r).sum()
    assert sum(abs(q[a, 0] - r[b, 0]) for a, b in found) < straight / 3


def labelled(seed, n=300):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, (n, 2))
    y[:, 1] = np.where(y[:, 1] == 2, seed, y[:, 1])  # classes that only one recording has
    x = rng.normal(size=(n, 5)) + 100 + 2 * y[:, :1] + np.outer(y[:, 1], np.arange(5)) / 3
    return [(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))]


def test_models_from_stored_sums_equal_those_of_all_frames(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "frame bigint, x array<double>, levels array<bigint>")
    parts = {name: labelled(seed) for name, seed in (("a", 3), ("b", 4), ("c", 5))}
    path = str(tmp_path / "model")
    for name, rows in parts.items():
        lda.store_sums(frame(rows), path, name, "x", "levels")

    def same(found, rows):
        want = lda.fit(frame(rows), "x", "levels")
        assert len(found) == len(want) == 2
        for a, b in zip(found, want, strict=True):
            assert (a.classes == b.classes).all() and np.allclose(a.coef, b.coef, rtol=1e-7, atol=1e-9) and np.allclose(a.intercept, b.intercept, rtol=1e-7, atol=1e-6)

    same(lda.fit_stored(spark, path), parts["a"] + parts["b"] + parts["c"])
    same(lda.fit_stored(spark, path, ["b", "c"]), parts["b"] + parts["c"])
    parts["b"] = labelled(7, 200)
    lda.store_sums(frame(parts["b"]), path, "b", "x", "levels")  # takes the place of what was there
    same(lda.fit_stored(spark, path), parts["a"] + parts["b"] + parts["c"])
    assert lda.fit_stored(spark, path, ["nobody"]) == []


def test_activations_are_the_patterns_behind_the_weights(spark):
    """By definition: the covariance, times the weights, times the inverse covariance of what the weights make of the frames."""
    rows = labelled(3)
    df = spark.createDataFrame(rows, "frame bigint, x array<double>, levels array<bigint>")
    models = lda.fit(df, "x", "levels")
    x = np.array([r[1] for r in rows])
    got = lda.activations(models, statistics.covariance(df, "x"))
    total = np.zeros(5)
    for m in models:
        s = x @ m.coef.T
        total += np.abs(np.cov(x.T) @ m.coef.T @ np.linalg.pinv(np.cov(s.T), rcond=1e-10)).sum(1)
    assert got == pytest.approx(total / (len(models) * max(len(m.classes) for m in models)), rel=1e-5)
    names = features.names(["LB1", "L-2", "LC"], 4)
    selected = [names[k] for k in (7, 0, 14, 3, 9)]
    grid = {(r["channel"], r["lag"]): r["activation"] for r in lda.activation_rows(spark, got, selected, ["LB1", "L-2", "LC"]).collect()}
    assert len(grid) == 15 and grid["LB1", 4] == got[1] and grid["L-2", 2] == got[0] and grid["LC", 0] == got[2] and sum(v != 0 for v in grid.values()) == 5


@pytest.mark.parametrize("features", [None, 3])
def test_runs_together_equal_runs_one_by_one(spark, monkeypatch, features):
    rng = np.random.default_rng(6)
    y = rng.normal(size=(203, 2))
    x = np.column_stack([y + 0.2 * rng.normal(size=y.shape), rng.normal(size=(203, 3))])
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "frame bigint, x array<double>, y array<double>").cache()
    told = lambda found: {(r["run"], r["frame"]): (r["fold"], r["orig"], r["reco"]) for r in found.collect()}
    runs = [0, 3, 8]
    together = told(experiment.reconstructed(df, "x", "y", 4, 5, run=runs, features=features))
    assert len(together) == 3 * 203
    one = {}
    for r in runs:
        one |= told(experiment.reconstructed(df, "x", "y", 4, 5, run=r, features=features))
    assert together == one
    monkeypatch.setattr(experiment, "MODELS", 1)  # each by itself
    assert told(experiment.reconstructed(df, "x", "y", 4, 5, run=runs, features=features)) == one
    r = lambda run: np.corrcoef([v[1][0] for k, v in sorted(together.items()) if k[0] == run], [v[2][0] for k, v in sorted(together.items()) if k[0] == run])[0, 1]
    assert r(0) > 0.6 and abs(r(3)) < 0.4 and abs(r(8)) < 0.4
