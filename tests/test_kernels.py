"""Closed-form and brute-force tests of what SQL cannot say."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonarframe.functions import arrays, filters, mel
from sonarframe.operators import clock, dtw, lda, vocoder
from sonarframe.sources import wav, xdf
from sonarframe.streaming.features import Features, Options


def gain(sections, hertz, sr):
    return abs(filters.response(sections, np.array([2 * np.pi * hertz / sr]))[0])


def test_band_pass_has_its_edges():
    s = filters.butterworth(8, "pass", (70, 170), 1024)
    assert s.shape == (8, 6)
    for edge in (70, 170):
        assert gain(s, edge, 1024) == pytest.approx(1 / math.sqrt(2), rel=1e-6)
    assert gain(s, 110, 1024) == pytest.approx(1, abs=1e-3)
    assert gain(s, 30, 1024) < 1e-3 and gain(s, 300, 1024) < 1e-3


def test_band_stop_takes_the_mains_out():
    s = filters.butterworth(8, "stop", (98, 102), 1024)
    assert gain(s, 100, 1024) < 1e-6
    assert gain(s, 80, 1024) == pytest.approx(1, abs=1e-6) and gain(s, 130, 1024) == pytest.approx(1, abs=1e-6)
    for edge in (98, 102):
        assert gain(s, edge, 1024) == pytest.approx(1 / math.sqrt(2), rel=1e-4)


def test_low_pass_of_odd_order():
    s = filters.butterworth(5, "low", (100,), 1000)
    assert gain(s, 100, 1000) == pytest.approx(1 / math.sqrt(2), rel=1e-6) and gain(s, 0, 1000) == pytest.approx(1)


def plain(sections, x, state):
    y = np.array(x, dtype=float)
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        s0, s1 = state[k, :, 0]
        for t, v in enumerate(y.copy()):
            y[t] = b0 * v + s0
            s0, s1 = b1 * v - a1 * y[t] + s1, b2 * v - a2 * y[t]
    return y


def test_blocks_equal_the_recursion():
    s = filters.butterworth(8, "pass", (70, 170), 1024)
    x = np.random.default_rng(0).normal(size=1000)
    state = filters.cold(s, x[:1])
    y, _ = filters.run(s, x[:, None], state, block=64)
    assert np.allclose(y[:, 0], plain(s, x, state), atol=1e-9)


def test_a_constant_stays_in_the_steady_state():
    s = filters.butterworth(4, "low", (100,), 1000)
    y, _ = filters.run(s, np.full((50, 1), 3.0), filters.cold(s, np.array([3.0])))
    assert np.allclose(y, 3.0)


@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.booleans())
@settings(max_examples=25, deadline=None)
def test_chunks_do_not_change_features(sizes, warm):
    x = np.random.default_rng(1).normal(size=sum(sizes) + 200)
    o = Options(warm=warm)
    whole = Features(o).feed(x)
    own, out, at = Features(o), [], 0
    for n in [*sizes, len(x)]:
        own = Features(o, own.state()) if at else own
        out += own.feed(x[at : at + n])
        at = min(at + n, len(x))
    assert [r[0] for r in out] == [r[0] for r in whole]
    assert np.allclose([r[1] for r in out], [r[1] for r in whole], atol=1e-8)
    assert np.allclose([r[2] for r in out], [r[2] for r in whole], atol=1e-8)


def test_frames_end_where_they_should():
    ends = lambda sr: [Features(Options(sr=sr)).end(k) for k in range(8)]
    assert ends(1024) == [51, 61, 71, 82, 92, 102, 112, 123]
    assert ends(2048)[:5] == [102, 122, 143, 163, 184]


def test_mel_rows_sum_to_one():
    m, inv = mel.matrix(129, 40, 16000), mel.inverse(129, 40, 16000)
    assert np.allclose(m.sum(1), 1) and (m >= 0).all()
    assert set(np.round(inv.sum(1), 9)) <= {0.0, 1.0}


def test_gaussian_taps():
    assert np.allclose(arrays.gaussian(0.5), [0.000264, 0.106451, 0.786571, 0.106451, 0.000264], atol=1e-6)


def brute_dtw(a, b):
    n, m = len(a), len(b)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(n):
        for j in range(m):
            d[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[n, m]


@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_path_is_cheapest(n, m, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
    steps = dtw.path(a, b)
    assert steps[0] == (0, 0) and steps[-1] == (n - 1, m - 1)
    assert all((q - p, s - r) in ((1, 0), (0, 1), (1, 1)) for (p, r), (q, s) in zip(steps, steps[1:], strict=False))
    assert sum(np.linalg.norm(a[i] - b[j]) for i, j in steps) == pytest.approx(brute_dtw(a, b))


def test_warping_takes_the_last_match_and_the_first_at_the_start():
    steps = list(zip([0, 0, 1, 1, 1, 2, 3, 3], [0, 1, 1, 2, 3, 3, 3, 4], strict=True))
    assert dtw.warping(steps, 4).tolist() == [0, 3, 3, 4]


def test_a_sequence_is_its_own_warp():
    x = np.random.default_rng(3).normal(size=(30, 4))
    assert dtw.warping(dtw.path(x, x), 30).tolist() == list(range(30))
    assert dtw.correlation(x, x) == pytest.approx(1)


def fitted(x, y):
    classes = np.unique(y)
    counts = np.array([(y == c).sum() for c in classes], dtype=float)
    return lda.solve(len(x), x.sum(0), x.T @ x, classes, counts, np.array([x[y == c].sum(0) for c in classes]))


def test_discriminant_equals_the_gaussian_rule():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 4)) @ rng.normal(size=(4, 4)) + np.array([[0, 0, 0, 0], [3, 0, 1, 0], [0, 4, 0, 1]])[y]
    m = fitted(x - x.mean(0), y)
    means = np.array([(x - x.mean(0))[y == c].mean(0) for c in range(3)])
    centred = (x - x.mean(0)) - means[y]
    inv = np.linalg.inv(centred.T @ centred / (600 - 3))
    score = (x - x.mean(0)) @ inv @ means.T - 0.5 * np.einsum("ci,ij,cj->c", means, inv, means) + np.log(np.bincount(y) / 600)
    assert (m.predict(x - x.mean(0)) == score.argmax(1)).all()
    assert (m.predict(x - x.mean(0)) == y).mean() > 0.8


def test_two_classes_one_class_and_missing_levels():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(200) < 0.5, 2, 7)
    x = rng.normal(size=(200, 3)) + 5.0 * (y == 7)[:, None]
    m = fitted(x, y)
    assert m.classes.tolist() == [2, 7] and (m.predict(x) == y).mean() > 0.95
    assert (fitted(x, np.full(200, 4)).predict(x) == 4).all()


def test_constant_features_have_no_weight():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 100)
    x = np.column_stack([rng.normal(size=100) + 6 * y, np.ones(100)])
    m = fitted(x - x.mean(0), y)
    assert np.allclose(m.coef[:, 1], 0) and (m.predict(x - x.mean(0)) == y).mean() > 0.95


def test_robust_line_ignores_outliers():
    t = np.arange(100.0)
    y = 2 + 0.5 * t
    y[::17] += 500
    (a,), (b,) = clock.huber_lines((t - t.mean()) / t.std(), y, np.array([0]))
    assert b / t.std() == pytest.approx(0.5, abs=0.01)
    assert a - b / t.std() * t.mean() == pytest.approx(2, abs=1)


def test_robust_lines_have_the_least_loss():
    """Each range's line against a search around it; ranges do not see each other."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 40, 200]
    t = np.concatenate([np.sort(rng.normal(size=n)) for n in sizes])
    y = 3 * t + rng.standard_t(1, len(t)) * 2
    starts = np.cumsum([0, *sizes[:-1]])
    a, b = clock.huber_lines(t, y, starts)
    for k, (lo, n) in enumerate(zip(starts, sizes)):
        def loss(p, q):
            r = np.abs(y[lo : lo + n] - p - q * t[lo : lo + n])
            return np.where(r <= 1, r * r / 2, r - 0.5).sum()

        least = loss(a[k], b[k])
        assert all(least <= loss(a[k] + p, b[k] + q) + 1e-9 for p in (-1e-3, 0, 1e-3) for q in (-1e-3, 0, 1e-3)), n
        assert (a[k], b[k]) == pytest.approx([x[0] for x in clock.huber_lines(t[lo : lo + n], y[lo : lo + n], np.array([0]))], rel=1e-6, abs=1e-6)


def test_waves_have_the_spectra_they_were_made_from():
    rng = np.random.default_rng(0)
    window, hop = np.hanning(257)[:-1], 64
    x = rng.normal(size=256 + 64 * 40)
    target = np.abs(vocoder.stft(x, window, hop))

    def miss(w):
        own = np.abs(vocoder.stft(w, window, hop))[: len(target)]
        own *= (own * target).sum() / (own**2).sum()
        return np.linalg.norm(own - target) / np.linalg.norm(target)

    start = rng.random(len(x))
    assert miss(vocoder.refined(target, window, hop, start, 30)) < 0.6 * miss(start)


def test_streaming_vocoder_timing_and_seed():
    frames = np.random.default_rng(0).normal(size=(12, 40))
    one, two = vocoder.Stream(seed=5), vocoder.Stream(seed=5)
    out = [one.feed(f) for f in frames]
    assert [len(o) for o in out] == [0] + [160] * 11
    assert (np.concatenate([two.feed(f) for f in frames]) == np.concatenate(out)).all()
    assert len(vocoder.Stream(phase="real").feed(frames[0])) == 0


def test_batch_vocoder_is_peak_normalised():
    w = vocoder.utterance(np.random.default_rng(0).normal(size=(20, 40)), np.random.default_rng(1))
    assert w.dtype == np.int16 and abs(int(np.abs(w.astype(int)).max()) - 32767) <= 1
    assert len(vocoder.utterance(np.zeros((0, 40)), np.random.default_rng(1))) == 0


def test_wave_files_come_back():
    x = np.random.default_rng(0).integers(-32768, 32767, 1000)
    sr, back = wav.parse(wav.dump(x, 16000))
    assert sr == 16000 and (back[:, 0] == x).all()


from .xdf_plain import chunk  # noqa: E402
from .xdf_plain import head as header  # noqa: E402


def container(cut=0, broken=False, sound=False):
    out = xdf.MAGIC + chunk(1, b"<info/>") + header(1, "Micromed", "EEG", "float32", 2, 100) + header(2, "words", "Markers", "string", 1, 0)
    if sound:
        out += header(3, "AudioCaptureWin", "Audio", "float32", 1, 200)
        out += chunk(3, struct.pack("<I", 3) + bytes([1, 12]) + b"".join((bytes([8]) + struct.pack("<d", 10.001) if k == 0 else b"\0") + struct.pack("<f", 10 * k) for k in range(12)))
    some = b"".join((bytes([8]) + struct.pack("<d", 10.0) if k == 0 else b"\0") + struct.pack("<2f", k, -k) for k in range(5))
    out += chunk(3, struct.pack("<I", 1) + bytes([1, 5]) + some)
    if broken:
        out += b"\x07garbage that is no chunk" + xdf.BOUNDARY
    out += chunk(5, xdf.BOUNDARY)
    text = b"".join(bytes([8]) + struct.pack("<d", t) + bytes([1, len(w)]) + w for t, w in ((10.012, b"experimentStarted"), (10.031, b"experimentEnded")))
    out += chunk(3, struct.pack("<I", 2) + bytes([1, 2]) + text)
    out += chunk(4, struct.pack("<Idd", 1, 9.0, 0.25))
    out += chunk(6, struct.pack("<I", 1) + b"<info><sample_count>5</sample_count></info>")
    return out[: len(out) - cut]


def test_read_experiment(spark, tmp_path):
    import gzip

    (tmp_path / "a.xdf").write_bytes(container())
    (tmp_path / "b.xdfz").write_bytes(gzip.compress(container()))
    rows = xdf.read(spark, f"{tmp_path}/*.xdf*")
    names = {(r["name"], r["type"], r["channels"], r["srate"], r["format"]) for r in xdf.streams(rows).collect()}
    assert names == {("Micromed", "EEG", 2, 100.0, "float32"), ("words", "Markers", 1, 0.0, "string")}
    got = sorted((r["idx"], r["x"][0]) for r in xdf.experiment(rows).where("path like '%a.xdf'").collect())
    assert got == [(0, 1.0), (1, 2.0)]
    assert xdf.clock(rows).count() == 2
    assert [r["label"] for r in xdf.experiment_markers(rows).where("path like '%a.xdf'").collect()] == ["experimentStarted"]


def test_experiment_of_two_kinds_and_clocks(spark, tmp_path):
    """The sound is cut at its samples nearest to those of the neural stream that are nearest to the markers; clock offsets move one stream."""
    (tmp_path / "a.xdf").write_bytes(container(sound=True))
    got = sorted((r["kind"], r["idx"], r["x"][0]) for r in xdf.experiment(xdf.read(spark, f"{tmp_path}/a.xdf")).collect())
    # neural samples 10.01 to 10.03, sound from 10.011 (of two as near: 10.006 and 10.011 are not) to 10.031
    assert got == [("Audio", k, 10.0 * (2 + k)) for k in range(4)] + [("sEEG", 0, 1.0), ("sEEG", 1, 2.0)]
    loaded = xdf.load(spark, f"{tmp_path}/a.xdf")
    t = {(r["stream"], r["idx"]): r["t"] for r in xdf.signals(loaded).collect()}
    assert [t[1, k] for k in range(5)] == pytest.approx([10.25 + k / 100 for k in range(5)]) and t[3, 0] == pytest.approx(10.001)
    assert len(t) == 17 and xdf.markers(loaded).count() == 2


def test_wave_source_and_trial_files(spark, tmp_path):
    x = np.arange(-500, 500)
    (tmp_path / "r.wav").write_bytes(wav.dump(x, 100))
    rows = wav.read(spark, f"{tmp_path}/r.wav")
    assert [r["v"] for r in rows.orderBy("idx").collect()] == x.tolist()
    trials = spark.createDataFrame([("s", 0, "one", 0, 200), ("s", 1, "two", 300, 500)], "stream string, trial int, word string, first bigint, end bigint")
    files = {r["name"]: r["content"] for r in wav.trial_files(rows.selectExpr("'s' as stream", "idx", "v"), trials, 100).collect()}
    assert set(files) == {"s/001-one", "s/002-two"}
    assert (wav.parse(files["s/002-two"])[1][:, 0] == x[300:500]).all()
