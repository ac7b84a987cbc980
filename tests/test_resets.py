"""Streams whose session, width or numbering changes, against batch runs of each part by itself."""

import numpy as np
import pytest

from sonarframe.operators.features import Options
from sonarframe.streaming import resets
from sonarframe.streaming.features import Features

O = Options()


def parts():
    """(stream, session, samples x channels) one after the other."""
    rng = np.random.default_rng(0)
    return [("a", "s1", rng.normal(size=(600, 2))), ("b", "s1", rng.normal(size=(360, 1))), ("a", "s2", rng.normal(size=(520, 2))), ("a", "s2", rng.normal(size=(280, 3))), ("b", "s1", rng.normal(size=(240, 1))), ("a", "s1", rng.normal(size=(160, 2)))]


def alone(x):
    """(frame, energies, features) of samples that nothing was before."""
    made = [Features(O).feed(x[:, c]) for c in range(x.shape[1])]
    return [(rows[0][0], [r[1] for r in rows], [v for r in rows for v in r[2]]) for rows in zip(*made, strict=True)]


@pytest.mark.parametrize("step", [170, 5000])
def test_each_part_is_as_if_it_were_alone(spark, tmp_path, step):
    rows, at = [], 0
    for stream, session, x in parts():
        for k, v in enumerate(x):
            rows.append((stream, session, at, k, v.tolist(), at // step))
            at += 1
    schema = "stream string, session string, at bigint, idx bigint, x array<double>, chunk bigint"
    for c in range(at // step + 1):
        spark.createDataFrame([r for r in rows if r[5] == c], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{c:04d}")
    for k, v in resets.STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = resets.neural(stream, O).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    finally:
        for k in resets.STORE:
            spark.conf.unset(k)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    run, want = {}, {}
    for stream, session, x in parts():
        run[stream] = run.get(stream, -1) + 1
        for frame, energy, features in alone(x):
            want[stream, run[stream], frame] = (session, energy, features)
    assert {(r["stream"], r["run"], r["frame"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        session, energy, features = want[r["stream"], r["run"], r["frame"]]
        assert None not in r["energy"] and None not in r["features"], r
        assert r["session"] == session and np.allclose(r["energy"], energy, atol=1e-8) and np.allclose(r["features"], features, atol=1e-8)


class Kept:
    """What a store keeps of one key, without Spark."""

    def __init__(self):
        self.one, self.many, self.timers = None, {}, set()

    getValueState = getMapState = lambda self, name, *_: self if name == "head" else self.Map(self)  # noqa: E731, N815
    exists, get = (lambda self: self.one is not None), (lambda self: self.one)
    update = lambda self, v: setattr(self, "one", v)
    listTimers, deleteTimer, registerTimer = (lambda self: iter(self.timers)), (lambda self, t: self.timers.discard(t)), (lambda self, t: self.timers.add(t))  # noqa: N815

    class Map:
        def __init__(self, kept):
            self.kept = kept

        getValue, updateValue, clear = (lambda self, k: self.kept.many[k]), (lambda self, k, v: self.kept.many.update({k: v})), (lambda self: self.kept.many.clear())  # noqa: N815


class Clock:
    def __init__(self, now):
        self.getCurrentProcessingTimeInMs = lambda: now


def test_silence_clears_what_was_kept():
    import pandas as pd

    x = parts()[0][2]
    kept, own = Kept(), resets._Frames(O, "stream", 500)
    own.init(kept)

    def feed(lo, hi, now):
        rows = pd.DataFrame({"session": "s1", "at": range(lo, hi), "idx": range(lo, hi), "x": list(x[lo:hi])})
        return [r for out in own.handleInputRows(("a",), iter([rows]), Clock(now)) for r in out.to_dict("records")]

    first = feed(0, 300, 1000)
    assert kept.timers == {1500} and len(kept.many) == 2
    second = feed(300, 400, 1400)
    assert kept.timers == {1900}  # the earlier one is gone
    assert [(r["frame"], r["energy"]) for r in first + second] == [(f, pytest.approx(e)) for f, e, _ in alone(x[:400])]
    assert all(out.empty for out in own.handleExpiredTimer(("a",), Clock(1900), None)) and not kept.many and not kept.timers
    third = feed(400, 600, 3000)
    assert {r["run"] for r in first + second} == {0} and {r["run"] for r in third} == {1}
    assert [(r["frame"], r["energy"]) for r in third] == [(f, pytest.approx(e)) for f, e, _ in alone(x[400:])]
