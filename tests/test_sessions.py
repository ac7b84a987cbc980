"""Sessions, decoding runs, stored models and decodings, masks and chance levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.operators import dtw, experiment, features, lda, quantize
from sonarframe.sources import sessions, wav
from sonarframe.streaming import sinks


@pytest.fixture(scope="module")
def session_rows(spark):
    rng = np.random.default_rng(0)
    rows = [("a", "sEEG", 100, k, [float(k), -float(k)]) for k in range(900)] + [("a", "Audio", 48000, k, [float(v)]) for k, v in enumerate(rng.normal(size=2400))]
    return sessions.signal(spark.createDataFrame(rows, "session string, kind string, sr int, idx bigint, x array<double>"))


def test_session_and_its_trials(spark, session_rows):
    made = sessions.session(session_rows, noise=0.0)
    sizes = {(r["kind"], r["sr"], r["ch"]): r["count"] for r in made.groupBy("kind", "sr", "ch").count().collect()}
    assert sizes == {("sEEG", 100, 0): 900, ("sEEG", 100, 1): 900, ("Audio", 16000, 0): 800}
    markers = spark.createDataFrame([("a", k, m) for k, m in enumerate(["experimentStarted", "start; yes ", "end;yes", "start;no", "end;no", "start;yes"])], "session string, idx bigint, label string")
    trials = sessions.trials(markers)
    assert sorted((r["trial"], r["word"], r["seconds"]) for r in trials.collect()) == [(0, "yes", 0.0), (1, "no", 3.0), (2, "yes", 6.0)]
    cut = sessions.cut(session_rows.where("kind = 'sEEG' and ch = 0"), trials).collect()
    assert sorted((r["trial"], r["idx"], r["v"]) for r in cut) == [(t, k, float(300 * t + k)) for t in range(3) for k in range(200)]
    assert {(r["kind"], r["max(idx)"]) for r in sessions.common_duration(session_rows).groupBy("kind").agg(F.max("idx")).collect()} == {("sEEG", 4), ("Audio", 2399)}


def test_decoding_run(spark, tmp_path):
    (tmp_path / "audio.wav").write_bytes(wav.dump(np.arange(400), 100))
    (tmp_path / "markers.csv").write_text("x,105.001,experimentStarted\ny,106.128,start;one\nz,107.5,end;one\nw,107.015,start;two\n")
    rows, trials = sessions.decoding_run(spark, f"{tmp_path}/audio.wav", f"{tmp_path}/markers.csv", 105.0)
    assert sorted((r["trial"], r["word"], r["seconds"]) for r in trials.collect()) == [(0, "one", 1.13), (1, "two", pytest.approx(2.02, abs=0.011))]
    got = sorted((r["idx"], r["v"]) for r in sessions.cut(rows, trials, 0.5).where("trial = 0").collect())
    assert got == [(k, 112.0 + k) for k in range(50)] or got == [(k, 113.0 + k) for k in range(50)]


def test_stored_training_decodes_the_same(spark, tmp_path):
    rng = np.random.default_rng(1)
    y = rng.normal(size=(300, 2))
    x = np.column_stack([y + 0.1 * rng.normal(size=y.shape), rng.normal(size=(300, 3))])
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y))], "frame bigint, x array<double>, mel array<double>")
    book = quantize.logistic_codebook(df.select("frame", F.posexplode("mel").alias("bin", "v"))).cache()
    borders = F.array(*(F.array(*map(F.lit, r["borders"])) for r in sorted(book.collect(), key=lambda r: r["bin"])))
    coded = df.select("frame", F.slice("x", 1, 2).alias("x"), F.transform("mel", lambda v, i: quantize.level(v, F.get(borders, i))).alias("levels"))
    models = lda.fit(coded, "x", "levels")
    path = str(tmp_path / "model")
    sessions.store_training(path, book, models, [0, 1], [7], df.select("frame", "x"))
    _, again, selection, bad = sessions.load_training(spark, path)
    assert selection == [0, 1] and bad == [7] and all(np.allclose(a.coef, b.coef) and (a.classes == b.classes).all() for a, b in zip(models, again))
    got = {r["frame"]: r["mel"] for r in sessions.decoded(df.select("frame", "x"), path).collect()}
    medians = [r["medians"] for r in sorted(book.collect(), key=lambda r: r["bin"])]
    for k in (0, 17, 299):
        assert got[k] == [medians[b][int(m.predict(x[k : k + 1, :2])[0])] for b, m in enumerate(models)]
    assert np.corrcoef(np.array([got[k][0] for k in range(300)]), y[:, 0])[0, 1] > 0.9
    sessions.store_decoding(str(tmp_path / "run"), spark.createDataFrame([(0, [1.0])], "frame int, mel array<double>"), df.select("frame"), df.select("frame"), {"b": "2", "a": "1"})
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "run/options")).orderBy("option").collect()] == [("a", "1"), ("b", "2")]


def test_trial_mask_by_definition(spark):
    n, sr, shift, context = 16_123, 1000, 0.01, 5
    starts = [1234, 5010, 9999]
    step = int(shift * sr)
    want = np.zeros(n // step - context, dtype=bool)
    for s in starts:
        a = int(np.ceil(s / step))
        want[a : a + 2 * sr // step] = True
    got = experiment.trial_mask(spark.createDataFrame([("s", n)], "stream string, n bigint"), spark.createDataFrame([("s", s) for s in starts], "stream string, start bigint"), sr)
    assert [r["inside"] for r in got.orderBy("idx").collect()] == want.tolist()


def test_chance_level_against_words_in_turn(spark):
    rng = np.random.default_rng(2)
    decoded, words = rng.normal(size=(5, 12, 3)), rng.normal(size=(2, 12, 3))
    d = spark.createDataFrame([(r, f, decoded[r, f].tolist()) for r in range(5) for f in range(12)], "run bigint, frame bigint, mel array<double>")
    w = spark.createDataFrame([(i, f"w{i}", f, words[i, f].tolist()) for i in range(2) for f in range(12)], "item bigint, word string, frame bigint, mel array<double>")
    got = {r["run"]: (r["word"], r["r"]) for r in experiment.chance(d, w, 2).collect()}
    for r in range(5):
        i = r % 2
        want = dtw.correlation(words[i][dtw.warping(dtw.path(decoded[r], words[i]), 12)], decoded[r])
        assert got[r][0] == f"w{i}" and got[r][1] == pytest.approx(want)


def test_resynthesised_trials_are_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    reco = spark.createDataFrame([("a", k, rng.normal(size=40).tolist()) for k in range(30)], "stream string, frame bigint, mel array<double>")
    trials = spark.createDataFrame([("a", 0, "yes", 0, 1600), ("a", 1, "no", 2400, 4000)], "stream string, trial int, word string, first bigint, end bigint")
    wav.write_files(experiment.resynthesised(reco, trials), str(tmp_path))
    for name in ("001-yes", "002-no"):
        sr, x = wav.parse((tmp_path / "a" / f"{name}.wav").read_bytes())
        assert sr == 16000 and x.shape == (1600, 1)
    assert len(list((tmp_path / "a").iterdir())) == 2


def test_names_of_features():
    assert features.names(["LB1", "LC2"], 2) == ["LB1-2", "LB1-1", "LB1-0", "LC2-2", "LC2-1", "LC2-0"]


def test_callable_as_a_sink(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    seen = []
    q = sinks.to_callback(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")), lambda df, k: seen.append((k, df.count())), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None and sum(n for _, n in seen) == 20
