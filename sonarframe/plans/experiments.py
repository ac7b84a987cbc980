"""Queries of the evaluations and of the composed feature pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiment, features
from ..sources.views import signal, wide_frames
from .models import warped_sql
from .registry import FRAMES, SIGNAL, query
from .spectra import high_gamma_sql

#: Forty-eight features and sixteen targets from the 64 numbers of a frame; RUNS is a parameter of the evaluation, of which published ones take a hundred.
FOLDS, RUNS = 10, 5


def decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_frames(spark, sf_dir).select("frame", F.slice("x", 17, 48).alias("x"), F.slice("x", 1, 16).alias("y"))


@query()
def experiment_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated reconstruction: mean and deviation over the folds of each bin's correlation."""
    reco = experiment.reconstructed(decoding(spark, sf_dir), "x", "y", FOLDS, features=32)
    return experiment.over_runs(experiment.correlations(reco, "fold"), "bin")


@query()
def experiment_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with features rotated against targets, over some runs."""
    reco = experiment.reconstructed(decoding(spark, sf_dir), "x", "y", FOLDS, run=range(1, RUNS + 1))
    return experiment.over_runs(experiment.correlations(reco, "run"), "bin")


_TRIALS = f"{FRAMES}, named AS (SELECT frame // 10 AS trial, y AS word FROM frames WHERE frame % 10 = 0), trials AS MATERIALIZED (SELECT word, trial, frame % 10 + 1 AS place, x FROM frames JOIN named ON frame // 10 = trial)"
_SESSION = "SELECT word AS pair, 0 AS utterance, place, x FROM trials WHERE trial % 2 = {0} AND trial = (SELECT min(trial) FROM named b WHERE b.word = trials.word AND b.trial % 2 = {0})"


@query(f"WITH RECURSIVE {_TRIALS}, {warped_sql(_SESSION.format(0), _SESSION.format(1))} SELECT n.pair AS word, round(avg(bins.r), 6) AS r FROM n LEFT JOIN bins ON bins.pair = n.pair WHERE n.n > 0 GROUP BY n.pair")
def experiment_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two sessions, warped to each other: the labels of the frames, in trials of ten frames."""
    f = wide_frames(spark, sf_dir).select(F.floor(F.col("frame") / 10).alias("trial"), (F.col("frame") % 10).alias("frame"), F.col("x").alias("mel"), "y")
    word = f.where("frame = 0").select("trial", F.col("y").alias("word"))
    f = f.join(word, "trial").select("word", "trial", "frame", "mel")
    return experiment.matching(f.where("trial % 2 = 0"), f.where("trial % 2 = 1")).select("word", F.round("r", 6).alias("r"))


@query(f"""WITH {SIGNAL}, n AS (SELECT stream, count(*) AS n FROM signal GROUP BY stream)
SELECT run, stream, ('0x' || substring(md5(concat_ws('|', stream::VARCHAR, run::VARCHAR, '0')), 1, 8))::BIGINT % (n - 20) AS first, ('0x' || substring(md5(concat_ws('|', stream::VARCHAR, run::VARCHAR, '0')), 1, 8))::BIGINT % (n - 20) + 20 AS end_ FROM n, range(4) r(run) WHERE n > 20""")
def random_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four seeded segments of 20 samples of each stream."""
    sizes = signal(spark, sf_dir).groupBy("stream").agg(F.count("*").alias("n"))
    s = experiment.random_segments(sizes, 4, 20)
    return s.select(F.col("run").cast("bigint").alias("run"), "stream", "first", F.col("end").alias("end_"))


def _features_sql(o: features.Options, batch: bool) -> str:
    """features.neural() or features.neural_batch() of signal."""
    size, lead, shift = int(o.length_ms / 1000 * o.sr), 0 if batch else o.lead, o.shift_ms / 1000 * o.sr
    lags = ", ".join(f"lag(energy, {o.step * k}) OVER w AS f{o.order - k}" if k else f"energy AS f{o.order}" for k in range(o.order, -1, -1))
    if batch:
        spans = f"SELECT stream, k AS frame, round_even(k * {shift!r}::DOUBLE, 0)::BIGINT AS b, round_even(k * {shift!r}::DOUBLE, 0)::BIGINT + {size} AS e FROM (SELECT stream, max(idx) + 1 AS n FROM filtered GROUP BY stream), range(20000) r(k) WHERE k < floor((n - {o.length_ms / 1000 * o.sr!r}::DOUBLE) / {shift!r}::DOUBLE) + 1"
    else:
        spans = f"SELECT stream, k AS frame, e - {size} AS b, e FROM (SELECT stream, n, k, CASE WHEN k = 0 THEN {size} ELSE round_even((k * {o.shift_ms!r}::DOUBLE + {size} / {o.sr!r}::DOUBLE * 1000) / 1000 * {o.sr!r}::DOUBLE, 0)::BIGINT END AS e FROM (SELECT stream, max(idx) + 1 AS n FROM filtered GROUP BY stream), range(20000) r(k)) WHERE e <= n"
    skip = o.order * o.step
    kept = ", ".join(f"round(coalesce(f{k}, 0), 5) AS f{k}" for k in range(o.order + 1))
    return f"""WITH RECURSIVE {SIGNAL.replace('AS (', 'AS MATERIALIZED (', 1)}, {high_gamma_sql(o.sr, o.lead)}, filtered AS MATERIALIZED (SELECT stream, idx + {lead} AS idx, v FROM high_gamma), spans AS ({spans}),
energy AS (SELECT f.stream, frame, ln(sum(v * v) + 0.01e0) AS energy FROM spans s JOIN filtered f ON f.stream = s.stream AND idx >= b AND idx < e GROUP BY f.stream, frame),
lagged AS (SELECT stream, frame, energy, {lags} FROM energy WINDOW w AS (PARTITION BY stream ORDER BY frame))
SELECT stream, {f"frame - {skip}" if batch else "frame"} AS frame, round(energy, 5) AS energy, {kept} FROM lagged{f" WHERE frame >= {skip}" if batch else ""}"""


def _flat(made: DataFrame, o: features.Options) -> DataFrame:
    return made.select("stream", "frame", F.round("energy", 5).alias("energy"), *(F.round(F.get("features", F.lit(k)), 5).alias(f"f{k}") for k in range(o.order + 1)))


ONLINE, BATCH = features.Options(), features.Options(length_ms=20, shift_ms=5, order=2, step=2)


@query(_features_sql(ONLINE, batch=False))
def neural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, frames, log energy and stacking as a stream emits them."""
    return _flat(features.neural(signal(spark, sf_dir), ONLINE), ONLINE)


@query(_features_sql(BATCH, batch=True))
def neural_features_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(features.neural_batch(signal(spark, sf_dir), BATCH), BATCH)
