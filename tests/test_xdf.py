"""The split container source against a reader from the first byte to the last, what it is asked for, and the writer."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.sources import xdf

from . import xdf_plain as plain


def random_container(seed, n=400, broken=True):
    """Six streams of all kinds of samples in short chunks with stamps in all manners, between many boundaries."""
    rng = np.random.default_rng(seed)
    streams = {1: ("Micromed", "EEG", "float32", 3, 100), 2: ("AudioCaptureWin", "Audio", "int16", 1, 1000), 3: ("words", "Markers", "string", 2, 0), 4: ("d", "X", "double64", 2, 0), 5: ("q", "X", "int64", 1, 7), 6: ("odd", "X", "float128", 1, 7), 7: ("i", "X", "int32", 2, 50), 8: ("b", "X", "int8", 4, 50)}
    parts = [xdf.MAGIC, plain.chunk(1, b"<info/>"), *(plain.head(s, *h) for s, h in streams.items())]
    t = dict.fromkeys(streams, 100.0)
    for k in range(n):
        s = int(rng.choice(list(streams)))
        fmt, width, rate = streams[s][2:]
        how = rng.integers(0, 4)
        rows = []
        for j in range(int(rng.integers(0, 7))):
            t[s] += (1 / rate if rate else 0.3) * rng.uniform(0.9, 1.1)
            stamp = t[s] if how == 1 or how == 0 and j == 0 or how == 2 and rng.random() < 0.5 else None
            values = ["".join(rng.choice(list("aé\n\0"), rng.integers(0, 4))) for _ in range(width)] if fmt == "string" else rng.integers(-100, 100, width).tolist()
            rows.append((stamp, values))
        parts.append(plain.samples(s, "float32" if fmt == "float128" else fmt, rows))
        if k % 5 == 0:
            parts.append(plain.chunk(4, struct.pack("<Idd", s, t[s], rng.normal())))
        if k % 7 == 0:
            parts.append(plain.chunk(5, xdf.BOUNDARY))
        if broken and k % 41 == 0:
            parts.append(b"\x07 no chunk at all " + bytes(range(200)) + xdf.BOUNDARY)
        if broken and k % 59 == 0:
            parts.append(plain.chunk(3, struct.pack("<I", 1) + bytes([1, 9]) + b"\0" * 20))  # more samples than there are bytes
    parts.append(plain.chunk(6, struct.pack("<I", 1) + b"<info><sample_count>5</sample_count></info>"))
    return b"".join(parts)


def told(rows):
    clean = lambda v: None if v is None else round(v, 7)
    return sorted(((r[0], r[1], r[2], clean(r[3]), clean(r[4]), r[5], r[6]) for r in rows), key=repr)


def spark_rows(df):
    return told(df.select("stream", "kind", "idx", "stamp", "offset", "x", "texts").collect())


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{c}")


@pytest.mark.parametrize("seed", [0, 1])
def test_many_tasks_read_one_file_as_one_would(spark, tmp_path, small_splits, seed):
    content = random_container(seed)
    (tmp_path / "a.xdf").write_bytes(content)
    parts = xdf.segments(spark, str(tmp_path))
    assert parts.rdd.getNumPartitions() > 8
    assert parts.select("block").distinct().count() > 8
    known = [r for r in plain.parse(content) if r[0] != 6 or r[1] != "sample"]
    assert spark_rows(xdf.read(spark, str(tmp_path))) == told(known)


def test_split_or_not_and_packed_or_not(spark, tmp_path, small_splits):
    content = random_container(2, 120)
    (tmp_path / "a.xdf").write_bytes(content)
    (tmp_path / "b.xdfz").write_bytes(gzip.compress(content))
    (tmp_path / "c.xdf.gz").write_bytes(gzip.compress(content))
    rows = xdf.read(spark, f"{tmp_path}/*").cache()
    found = {name: spark_rows(rows.where(F.col("path").endswith(name))) for name in ("a.xdf", "b.xdfz", "c.xdf.gz")}
    assert found["a.xdf"] == found["b.xdfz"] == found["c.xdf.gz"] == told(plain.parse(content))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert spark_rows(xdf.read(spark, f"{tmp_path}/a.xdf")) == found["a.xdf"]


def test_what_is_not_asked_for_is_not_decoded(spark, tmp_path, small_splits):
    content = random_container(3, broken=False)
    (tmp_path / "a.xdf").write_bytes(content)
    every = plain.parse(content)

    def asked(**options):
        counter = spark.sparkContext.accumulator(0)
        return spark_rows(xdf.read(spark, str(tmp_path), counter=counter, **options)), counter.value

    all_rows, of_all = asked()
    assert all_rows == told(every)
    rows, of_one = asked(names=["Micromed"])
    assert rows == told(r for r in every if r[0] == 1)
    markers, of_markers = asked(types=["Markers"])
    assert markers == told(r for r in every if r[0] == 3)
    rows, both = asked(names=["Micromed"], types=["Markers"])
    assert rows == told(r for r in every if r[0] in (1, 3)) and both == of_one + of_markers and 0 < of_one < of_all / 4
    rows, n = asked(kinds=("header", "clock"))
    assert rows == told(r for r in every if r[1] in ("header", "clock")) and n == 0
    rows, n = asked(names=["Micromed"], kinds=("sample",), channels=[2, 0])
    assert rows == told((*r[:5], [r[5][2], r[5][0]], None) for r in every if r[0] == 1 and r[1] == "sample") and n == of_one
    assert asked(names=["nobody"]) == ([], 0)


def test_stamps_reach_over_segments(spark, tmp_path, small_splits):
    """One stamp at the beginning and one late; between them only the rate tells."""
    parts = [xdf.MAGIC, plain.head(1, "x", "X", "double64", 40, 10)]
    for k in range(60):
        parts += [plain.samples(1, "double64", [(5.0 if k == 1 and j == 1 else 99.0 if k == 50 and j == 0 else None, [float(4 * k + j)] * 40) for j in range(4)]), plain.chunk(5, xdf.BOUNDARY)]
    (tmp_path / "a.xdf").write_bytes(b"".join(parts))
    t = {r["idx"]: r["t"] for r in xdf.signals(xdf.read(spark, str(tmp_path))).collect()}
    want = [(k + 1) / 10 if k < 5 else 5 + (k - 5) / 10 if k < 200 else 99 + (k - 200) / 10 for k in range(240)]
    assert [t[k] for k in range(240)] == pytest.approx(want)


def test_neural_streams_of_other_tasks(spark, tmp_path):
    def container(sound):
        parts = [xdf.MAGIC, plain.head(1, "Micromed", "EEG", "float32", 1, 10), plain.head(3, "words", "Markers", "string", 1, 0)]
        parts += [plain.head(2, "AudioCaptureWin", "Audio", "float32", 1, 20), plain.samples(2, "float32", [(k / 20, [k]) for k in range(60)])] if sound else []
        parts += [plain.samples(1, "float32", [(k / 10, [k]) for k in range(30)]), plain.samples(3, "string", [(0.5, ["experimentStarted"]), (2.0, ["experimentEnded"])])]
        return b"".join(parts)

    (tmp_path / "a.xdf").write_bytes(container(True))
    (tmp_path / "b.xdf").write_bytes(container(False))
    counter = spark.sparkContext.accumulator(0)
    rows = xdf.neural(spark, str(tmp_path), counter=counter, dejitter=False).select("path", "idx", "x").collect()
    for name in "ab":
        assert sorted((r["idx"], r["x"][0]) for r in rows if f"{name}.xdf" in r["path"]) == [(k - 5, float(k)) for k in range(5, 20)]
    sound, markers = xdf.recording(spark, str(tmp_path / "a.xdf"), dejitter=False)
    assert {r["kind"]: r["count"] for r in sound.groupBy("kind").count().collect()} == {"sEEG": 15, "Audio": 30}
    assert [r["label"] for r in markers.collect()] == ["experimentStarted"]


def test_labels_of_channels(spark, tmp_path):
    xml = "<info><name>n</name><type>t</type><channel_count>2</channel_count><nominal_srate>1</nominal_srate><channel_format>int8</channel_format><desc><channels><channel><label>LB1</label></channel><channel><label>LB2</label></channel></channels></desc></info>"
    (tmp_path / "a.xdf").write_bytes(xdf.MAGIC + plain.chunk(2, struct.pack("<I", 4) + xml.encode()))
    rows = xdf.read(spark, str(tmp_path))
    assert [(r["stream"], r["ch"], r["name"]) for r in xdf.labels(rows).orderBy("ch").collect()] == [(4, 0, "LB1"), (4, 1, "LB2")]


def test_no_container(spark, tmp_path):
    (tmp_path / "a.xdf").write_bytes(b"RIFF and so on")
    with pytest.raises(Exception, match="is not an XDF file"):
        xdf.read(spark, str(tmp_path)).count()
    with pytest.raises(ValueError):
        plain.parse(b"RIFF")


def test_written_containers_come_back(spark, tmp_path, small_splits):
    rows = [(f"r{s % 2}", s, k, None if k % 3 else 7 + k / 8, [float(k), float(s)]) for s in (1, 2, 5) for k in range(700)]
    samples = spark.createDataFrame(rows, "recording string, stream int, idx bigint, t double, x array<double>")
    heads = spark.createDataFrame([(f"r{s % 2}", s, xdf.header(f"s{s}", "EEG", 2, 8.0)) for s in (1, 2, 5)], "recording string, stream int, xml string")
    xdf.write(xdf.packed(samples, heads, per=64), f"{tmp_path}/out")
    back = xdf.read(spark, f"{tmp_path}/out/*", files="part-*")
    got = sorted((r["stream"], r["idx"], r["t"], r["x"]) for r in xdf.signals(back).collect())
    assert got == sorted((s, k, 7 + k / 8, x) for _, s, k, _, x in rows)
    files = list((tmp_path / "out").glob("recording=*/part-*"))
    assert len(files) == 2 and all(told(plain.parse(f.read_bytes())) for f in files)
