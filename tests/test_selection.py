"""Order statistics, medians, median cut and robust lines by rounds of sums, against what sorts and single tasks find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.operators import clock, quantize, selection, statistics


def groups(seed=0):
    rng = np.random.default_rng(seed)
    return {
        "normal": rng.normal(size=3000), "ties": rng.integers(-3, 4, 2000).astype(float), "one": np.array([2.5]), "two": np.array([-1.0, 4.0]), "same": np.full(500, 7.25),
        "wide": 10.0 ** rng.uniform(-300, 300, 2000) * rng.choice([-1, 1], 2000), "ends": np.array([-np.inf, np.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]), "heavy": np.concatenate([np.full(4000, 1.0), 1 + np.arange(500) * 2.0**-52]), None: rng.exponential(size=701),
    }


def frame(spark, found):
    rows = [(k, float(v)) for k, vs in found.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("void", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("small, bins", [(4096, 1024), (5, 16)])
def test_order_statistics_equal_a_sort(spark, small, bins):
    found = groups()
    ks = {g: sorted({0, len(v) - 1, len(v) // 2, (len(v) - 1) // 2, len(v) // 7, len(v) + 3}) for g, v in found.items()}
    wanted = spark.createDataFrame([(g, k) for g, own in ks.items() for k in own for _ in range(2)] + [("void", 0), ("nobody", 0)], "g string, k int")
    got = {(r["g"], r["k"]): (r["v"], r["less"], r["equal"]) for r in selection.order_statistics(frame(spark, found), ["g"], "v", wanted, small=small, bins=bins).collect()}
    want = {}
    for g, own in ks.items():
        v = np.sort(found[g])
        for k in own:
            if k < len(v):
                want[g, k] = (v[k], int((v < v[k]).sum()), int((v == v[k]).sum()))
    assert got == want


def test_medians_equal_numpy(spark):
    found = groups(1)
    df = frame(spark, found)
    got = {r["g"]: (r["m"], r["squared"]) for r in selection.medians(df, ["g"], m="v", squared=F.when(F.col("g") != "one", F.col("v") / 4)).collect()}
    assert set(got) == set(found)
    for g, v in found.items():
        v = np.sort(v)
        middle = 0.5 * v[(len(v) - 1) // 2] + 0.5 * v[len(v) // 2]
        assert got[g][0] == middle and got[g][1] == (None if g in ("one", None) else pytest.approx(middle / 4, rel=1e-15))
    s = {r["g"]: (r["median"], r["std"]) for r in statistics.summary(df, "v", "g").collect()}
    assert s["normal"] == (np.median(found["normal"]), pytest.approx(found["normal"].std())) and s["void"] == (None, None)
    assert statistics.summary(df.where("g = 'two'"), "v").collect()[0]["median"] == 1.5
    assert [tuple(r) for r in statistics.summary(df.where("g = 'nobody'"), "v").collect()] == [(None, None, None)]


def by_sorting(values, levels):
    """The longest interval is taken, sorted and cut at its median value, until there are enough or none can be cut."""
    intervals, done = [np.sort(values)], []
    while intervals and len(intervals) + len(done) < levels:
        intervals.sort(key=len)
        x = intervals.pop()
        middle = x[len(x) // 2]
        if (x > middle).any():
            intervals += [x[x <= middle], x[x > middle]]
        else:
            done.append(x)
    found = sorted(intervals + done, key=np.median)
    return [x[-1] for x in found], [float(np.median(x)) for x in found]


@pytest.mark.parametrize("levels", [1, 4, 9, 16])
def test_median_cut_equals_sorting_each_interval(spark, levels):
    found = {k: v for k, v in groups(2).items() if k not in (None, "ends", "wide")}
    found["even"] = np.arange(512.0)
    df = frame(spark, found).where("g <> 'void'")
    got = {r["g"]: (r["borders"], r["medians"]) for r in quantize.median_cut_codebook(df, levels, "g").collect()}
    assert set(got) == set(found)
    for g, v in found.items():
        assert got[g] == by_sorting(v, levels), g


def test_lines_by_sums_equal_lines_in_a_task(spark):
    rng = np.random.default_rng(4)
    rows, parts = [], {}
    for g, n in (("a", 500), ("b", 3), ("c", 40), ("d", 2), ("flat", 30), ("e", 801)):
        x = np.zeros(n) if g == "flat" else rng.normal(size=n) * 2
        y = 3 * x - 1 + rng.normal(size=n) * (0.1 if g == "a" else 3) + np.where(rng.random(n) < 0.2, rng.normal(size=n) * 50, 0)
        parts[g] = (x, y)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    got = {r["g"]: (r["a"], r["b"]) for r in clock.huber_sums(spark.createDataFrame(rows, "g string, x double, y double").repartition(5), ["g"]).collect()}
    assert set(got) == set(parts)
    loss = lambda x, y, a, b: np.where(np.abs(r := y - a - b * x) <= 1, r * r / 2, np.abs(r) - 0.5).sum()
    for g, (x, y) in parts.items():
        a, b = (v[0] for v in clock.huber_lines(x, y, np.array([0])))
        assert loss(x, y, *got[g]) == pytest.approx(loss(x, y, a, b), rel=1e-9, abs=1e-12)
        if g in "ace":
            assert got[g] == pytest.approx((a, b), rel=1e-7, abs=1e-7)


def test_large_and_small_ranges_are_fitted_alike(spark):
    rng = np.random.default_rng(5)
    rows = [(s, r, k, 5.0 * k + 1000 * r, 2 + 1e-5 * k + 1e-5 * rng.normal() + (0.05 if rng.random() < 0.1 else 0)) for s in "xy" for r in range(2) for k in range(30 if s == "x" else 400)] + [("z", 0, 0, 3.0, 0.5)]
    df = spark.createDataFrame(rows, "stream string, range bigint, seq bigint, t double, offset double").repartition(6)
    told = lambda found: {(r["stream"], r["range"]): (r["start"], r["intercept"], r["slope"]) for r in found.collect()}
    whole, summed = told(clock.fitted(df)), told(clock.fitted(df, whole_=100))
    assert set(whole) == set(summed) and len(whole) == 5
    for k, (start, a, b) in whole.items():
        assert summed[k] == (start, pytest.approx(a, rel=1e-8), pytest.approx(b, rel=1e-6))
