"""The HDF5 source on files written byte by byte, and sessions and runs by their folders."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.sources import hdf5, recordings, sessions, wav

from .hdf5_plain import Writer


def rows_of(df, name):
    found = sorted((r["idx"], r["x"], r["texts"]) for r in df.where(F.col("name") == name).collect())
    assert [k for k, _, _ in found] == list(range(len(found)))
    return [x if x is not None else t for _, x, t in found]


def test_layouts_filters_and_kinds(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = {
        "plain": rng.normal(size=(50, 3)), "line": rng.normal(size=70).astype("<f4"), "big": rng.integers(-9, 9, (11, 2)).astype(">i2"), "unsigned": rng.integers(0, 200, 9).astype("u1"), "single": np.float64(2.5), "few": np.arange(6, dtype="<i4").reshape(3, 2),
        "chunks": rng.normal(size=(53, 7)), "packed": rng.integers(-1000, 1000, (53, 7)).astype("<i4"), "long": rng.normal(size=101), "summed": rng.normal(size=(20, 2)), "words": np.array([b"abc", b"d", b"", "é".encode()], dtype="S5"), "none": np.zeros((0, 4)),
    }
    w = Writer()
    how = {"chunks": {"chunk": (10, 3)}, "packed": {"chunk": (10, 3), "filters": (2, 1)}, "long": {"chunk": (8,), "filters": (1,)}, "summed": {"chunk": (6, 2), "filters": (2, 1, 3)}, "few": {"compact": True}, "big": {"space": 2}, "plain": {"split": True}}
    members = {name: w.dataset(x, **how.get(name, {})) for name, x in data.items()}
    members["any"] = w.strings([b"one", b"", "größe".encode(), b"a much longer string than the others"])
    (tmp_path / "a.h5").write_bytes(w.close(members))
    found = hdf5.read(spark, f"{tmp_path}/a.h5", [*members, "absent"]).cache()
    for name, x in data.items():
        want = [[v.decode()] for v in x.tolist()] if x.dtype.kind == "S" else np.asarray(x, dtype=float).reshape((x.shape[0] if x.ndim else 1, -1) if x.size else x.shape).tolist()
        assert rows_of(found, name) == want, name
    assert rows_of(found, "any") == [["one"], [""], ["größe"], ["a much longer string than the others"]]
    assert found.where("name = 'absent'").count() == 0


def test_chunks_are_dealt_to_tasks_and_absent_ones_have_no_rows(spark, tmp_path, monkeypatch):
    x = np.arange(400.0).reshape(100, 4)
    w = Writer()
    (tmp_path / "a.h5").write_bytes(w.close({"x": w.dataset(x, chunk=(5, 4), filters=(1,), skip=(3, 4))}))
    found = hdf5.read(spark, f"{tmp_path}/*.h5", ["x"])
    got = {r["idx"]: r["x"] for r in found.collect()}
    assert got == {k: x[k].tolist() for k in range(100) if not 15 <= k < 25}
    assert found.select(F.spark_partition_id()).distinct().count() > 5
    with open(tmp_path / "a.h5", "rb") as source:
        file = hdf5.File(source)
        monkeypatch.setattr(hdf5, "PIECE", 96)
        assert len(list(hdf5.pieces(file, "x", file.members(file.root)["x"]))) == 18


def test_other_files(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(b"x" * 200)
    with pytest.raises(Exception, match="not an HDF5 file"):
        hdf5.read(spark, f"{tmp_path}/a.h5", ["x"]).count()
    w = Writer()
    whole = w.close({"x": w.dataset(np.arange(1000.0))})
    (tmp_path / "b.h5").write_bytes(whole[:-100])
    with pytest.raises(Exception, match="cut off"):
        hdf5.read(spark, f"{tmp_path}/b.h5", ["x"]).count()


def speech(seed, named=True):
    rng = np.random.default_rng(seed)
    w = Writer()
    eeg, audio = rng.normal(size=(1300, 3)), rng.normal(size=6000).astype("<f4")
    marks = np.array([["experimentStarted"], ["start;yes "], ["end;yes"], ["start;no"], ["experimentEnded"]], dtype="S20")
    members = {"sEEG": w.dataset(eeg, chunk=(100, 2), filters=(1,)), "Audio": w.dataset(audio), "sEEG_sr": w.dataset(np.int64(200)), "Audio_sr": w.dataset(np.array([48000], "<i4")), "markers": w.dataset(marks)}
    if named:
        members["ch_names"] = w.dataset(np.array([b"LB1", b"LB2", b"LC1"]))
    return eeg, audio, w.close(members)


def test_sessions_by_folder(spark, tmp_path):
    want = {}
    for name, seed in (("one", 1), ("two", 2)):
        (tmp_path / name).mkdir()
        eeg, audio, raw = speech(seed, name == "one")
        want[name] = eeg
        (tmp_path / name / "speech1.hdf").write_bytes(raw)
    made, trials = sessions.session_folder(spark, f"{tmp_path}/*", noise=0.0)
    made = made.cache()
    sizes = {(r["session"], r["kind"], r["sr"], r["ch"]): r["count"] for r in made.groupBy("session", "kind", "sr", "ch").count().collect()}
    assert sizes == {(s, k, sr, c): n for s in want for k, sr, c, n in (("sEEG", 200, 0, 1300), ("sEEG", 200, 1, 1300), ("sEEG", 200, 2, 1300), ("Audio", 16000, 0, 2000))}
    assert sorted(map(tuple, trials.collect())) == [(s, t, w, 3.0 * t) for s in want for t, w in ((0, "yes"), (1, "no"))]
    cut = sessions.cut(made.where("kind = 'sEEG' and ch = 1"), trials).where("session = 'two' and trial = 1").collect()
    assert sorted((r["idx"], r["v"]) for r in cut) == [(k, want["two"][600 + k, 1]) for k in range(400)]
    names = recordings.channels(spark, f"{tmp_path}/*/speech1.hdf").collect()
    assert sorted(r["name"] for r in names if "/one/" in r["path"]) == ["LB1", "LB2", "LC1"] and sorted(r["name"] for r in names if "/two/" in r["path"]) == ["ch_000", "ch_001", "ch_002"]
    assert {(r["kind"], r["sr"]): r["count"] for r in recordings.signals(spark, f"{tmp_path}/one/speech1.hdf").groupBy("kind", "sr").count().collect()} == {("sEEG", 200): 1300, ("Audio", 48000): 6000}


def test_runs_by_folder(spark, tmp_path):
    for run, begin in (("r1", 105.0), ("r2", 100.5)):
        (tmp_path / run).mkdir()
        w = Writer()
        (tmp_path / run / "sEEG.hdf").write_bytes(w.close({"sEEG": w.dataset(np.arange(40.0).reshape(20, 2)), "sEEG_sr": w.dataset(np.int32(100))}))
        (tmp_path / run / "audio.wav").write_bytes(wav.dump(np.arange(400), 100))
        (tmp_path / run / "markers.csv").write_text("x,105.001,experimentStarted\ny,106.128,start;one\nz,107.5,end;one\nw,107.016,start;two\n")
        buffer = io.BytesIO()
        np.save(buffer, np.array([begin]))
        (tmp_path / run / "first_timestamp.npy").write_bytes(buffer.getvalue())
    rows, trials = sessions.run_folder(spark, f"{tmp_path}/r*")
    assert sorted((r["session"], r["trial"], r["word"], r["seconds"]) for r in trials.collect()) == [("r1", 0, "one", 1.13), ("r1", 1, "two", 2.02), ("r2", 0, "one", 5.63), ("r2", 1, "two", 6.52)]
    sizes = {(r["session"], r["kind"], r["sr"], r["ch"]): (r["n"], r["v"]) for r in rows.groupBy("session", "kind", "sr", "ch").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}
    assert sizes == {(s, *k): v for s in ("r1", "r2") for k, v in {("Audio", 100, 0): (400, 79800.0), ("sEEG", 100, 0): (20, 380.0), ("sEEG", 100, 1): (20, 400.0)}.items()}
