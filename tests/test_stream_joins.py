"""Joins of two streams through time, with markers that come late, against the same by definition."""

from datetime import datetime, timedelta, timezone

import pytest

from sonarframe.streaming import joins

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
HZ = 20


def at(seconds):
    return START + timedelta(seconds=seconds)


def played(spark, path, chunks, schema):
    """A stream of which each chunk is a batch."""
    for k, rows in enumerate(chunks):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def result(df, tmp_path):
    q = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/out").collect()


#: Seconds of the markers of two streams; those of a batch may belong to samples of an earlier one, or of a later.
MARKERS = [[("a", 1.0, "start;one")], [("b", 0.525, "start;two"), ("a", 0.3, "start;late"), ("a", 5.0, "end;one")], [("a", 7.975, "start; spaced "), ("b", 3.0, "start;again")], []]


@pytest.fixture
def streams(spark, tmp_path):
    samples = [[(s, at(k / HZ), float(k)) for s in "ab" for k in range(lo * 3 * HZ, (lo + 1) * 3 * HZ)] for lo in range(3)]
    samples.append([(s, at(60.0), -1.0) for s in "ab"])  # lets the watermark pass
    marks = [[(s, at(t), label) for s, t, label in rows] for rows in MARKERS]
    marks[3] = [(s, at(60.0), "none") for s in "ab"]
    return played(spark, f"{tmp_path}/samples", samples, "stream string, ts timestamp, v double"), played(spark, f"{tmp_path}/markers", marks, "stream string, ts timestamp, label string")


def test_late_markers_have_their_samples(streams, tmp_path):
    samples, markers = streams
    got = sorted((r["stream"], r["word"], r["v"]) for r in result(joins.in_trials(samples, markers, 2.0), tmp_path))
    trials = [(s, t, label[6:].strip()) for rows in MARKERS for s, t, label in rows if label.startswith("start;")]
    assert got == sorted((s, word, float(k)) for s, t, word in trials for k in range(9 * HZ) if t <= k / HZ < t + 2)


def test_nearest_samples_of_markers(streams, tmp_path):
    samples, markers = streams
    got = {(r["stream"], r["label"]): r["value"] for r in result(joins.nearest(markers, samples, "v"), tmp_path) if r["label"] != "none"}
    want = {(s, label): float(min(range(9 * HZ), key=lambda k: (round(abs(k / HZ - t), 9), k))) for rows in MARKERS for s, t, label in rows}
    assert got == want and got["b", "start;two"] == 10.0  # of 0.5 and 0.55 the earlier
