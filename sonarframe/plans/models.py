"""Queries of the linear discriminant models, clocks and warping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import clock, dtw, frames, lda, quantize, statistics
from ..operators.staging import beside
from ..sources.views import signal, wide_frames
from .registry import FRAMES, SIGNAL, query


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with one target, their label."""
    return wide_frames(spark, sf_dir).withColumn("levels", F.array("y"))


@query(f"WITH {FRAMES}, l AS (SELECT y AS level, unnest(range(64)) AS feature, unnest(x) AS v FROM frames) SELECT level, feature, count(*) AS n, round(sum(v), 6) AS s FROM l GROUP BY level, feature")
def lda_suffstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lda.class_sums(labelled(spark, sf_dir), "x", "levels").select("level", F.col("at").alias("feature"), "n", F.round("s", 6).alias("s"))


def fixed_model() -> lda.Model:
    """A model whose weights follow a rule, so that SQL can have the same."""
    c, k = np.arange(10)[:, None], np.arange(64)[None, :]
    return lda.Model(np.arange(10), np.cos(c * k + c), np.arange(10) / 100)


@query(f"""WITH {FRAMES}, s AS (SELECT frame, c, sum(x[k + 1] * cos(c * k + c)) + c / 100.0e0 AS score FROM frames, range(10) r(c), range(64) q(k) GROUP BY frame, c)
SELECT frame, arg_max(c, score) AS predicted FROM s GROUP BY frame""")
def lda_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lda.predicted(wide_frames(spark, sf_dir), "x", [fixed_model()])
    return found.select("frame", F.get("predicted", F.lit(0)).alias("predicted"))


@query()
def lda_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on all frames, then applied to them."""
    rows = labelled(spark, sf_dir)
    return lda.predicted(rows, "x", lda.fit(rows, "x", "levels")).select("frame", "y", F.get("predicted", F.lit(0)).alias("predicted"))


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the levels of their first eight numbers as targets and the rest as features."""
    rows = wide_frames(spark, sf_dir).select("frame", F.slice("x", 9, 56).alias("x"), F.slice("x", 1, 8).alias("mel"))
    book = sorted(quantize.logistic_codebook(rows.select("frame", F.posexplode("mel").alias("bin", "v"))).collect(), key=lambda r: r["bin"])  # eight rows
    borders = F.array(*(arrays.vector(r["borders"]) for r in book))
    return rows.withColumn("levels", F.transform("mel", lambda v, i: quantize.level(v, F.get(borders, i))))


@query()
def lda_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of eight targets as a table."""
    return lda.table(spark, lda.fit(coded(spark, sf_dir), "x", "levels"))


@query()
def activation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature and activation: how strongly the models' sources show in each feature."""
    rows = coded(spark, sf_dir)
    found = lda.activations(lda.fit(rows, "x", "levels"), statistics.covariance(rows, "x"))
    return spark.createDataFrame([(k, float(a)) for k, a in enumerate(found)], "feature bigint, activation double")


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock measurements of each stream: an offset that drifts, with outliers, and a clock that starts anew half-way."""
    s = signal(spark, sf_dir)
    s = beside(s, frames.lengths(s, "stream"), ["stream"])
    late = F.col("idx") * 2 >= F.col("_n")
    t = F.when(late, F.col("idx") * 5.0 - 10_000).otherwise(F.col("idx") * 5.0)
    offset = t * 1e-5 + F.when(late, 500.0).otherwise(2.0) + F.when(F.col("label") == "error", 0.05).otherwise(0.0)
    return s.select("stream", F.col("idx").alias("seq"), t.alias("t"), offset.alias("offset"))


@query(f"""WITH {SIGNAL}, n AS (SELECT stream, count(*) AS n FROM signal GROUP BY stream) SELECT stream, idx AS seq, CASE WHEN idx * 2 >= n AND n > 1 THEN 1 ELSE 0 END AS range FROM signal JOIN n USING (stream)""")
def clock_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.ranges(offsets(spark, sf_dir)).select("stream", "seq", F.col("range").cast("int").alias("range"))


@query()
def huber_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clock.fitted(clock.ranges(offsets(spark, sf_dir)))


@query()
def clock_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offsets(spark, sf_dir)
    return clock.synchronised(o.select("stream", F.col("seq").alias("idx"), "t"), o).select("stream", "idx", "t")


def warped_sql(query_side: str, reference_side: str) -> str:
    """CTEs of which n (pair, utterance, n) has all pairs of two selects (pair, utterance, place from 1, x) and bins (pair, utterance, bin, r) the correlations after warping.

    Costs go along anti-diagonals with the step that led to each cell, then the way back from the last one.
    """
    return f"""q AS MATERIALIZED ({query_side}), r AS MATERIALIZED ({reference_side}),
n AS MATERIALIZED (SELECT pair, utterance, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS n FROM (SELECT pair, utterance, 0 AS side FROM q UNION ALL SELECT pair, utterance, 1 FROM r) GROUP BY pair, utterance),
cost AS MATERIALIZED (SELECT pair, utterance, n, list(list_distance(q.x, r.x) ORDER BY q.place, r.place) AS c FROM n JOIN q USING (pair, utterance) JOIN r USING (pair, utterance) WHERE n > 1 AND q.place <= n AND r.place <= n GROUP BY pair, utterance, n),
dp AS (SELECT pair, utterance, n, c, 1 AS d, [CASE WHEN i = 0 THEN 0e0 ELSE 'inf'::DOUBLE END FOR i IN range(n + 1)] AS before, ['inf'::DOUBLE FOR i IN range(n + 1)] AS last, []::BIGINT[][] AS steps FROM cost
UNION ALL SELECT pair, utterance, n, c, d + 1, last, [CASE WHEN i >= greatest(1, d + 1 - n) AND i <= least(n, d) THEN c[(i - 1) * n + d + 1 - i] + least(before[i], last[i], last[i + 1]) ELSE 'inf'::DOUBLE END FOR i IN range(n + 1)],
list_append(steps, [CASE WHEN i < 1 THEN 0 WHEN before[i] <= least(last[i], last[i + 1]) THEN 0 WHEN last[i] <= last[i + 1] THEN 1 ELSE 2 END::BIGINT FOR i IN range(n + 1)]) FROM dp WHERE d < 2 * n),
walk AS (SELECT pair, utterance, steps, n AS i, n AS j FROM dp WHERE d = 2 * n
UNION ALL SELECT pair, utterance, steps, i - (steps[i + j - 1][i + 1] <> 2)::BIGINT, j - (steps[i + j - 1][i + 1] <> 1)::BIGINT FROM walk WHERE i - (steps[i + j - 1][i + 1] <> 2)::BIGINT > 0 AND j - (steps[i + j - 1][i + 1] <> 1)::BIGINT > 0),
way AS (SELECT pair, utterance, i, CASE WHEN i = 1 THEN 1 ELSE max(j) END AS j FROM walk GROUP BY pair, utterance, i),
matched AS (SELECT w.pair, w.utterance, unnest(range(64)) AS bin, unnest(q.x) AS a, unnest(r.x) AS b FROM way w JOIN q ON q.pair = w.pair AND q.utterance = w.utterance AND q.place = w.i JOIN r ON r.pair = w.pair AND r.utterance = w.utterance AND r.place = w.j),
bins AS (SELECT pair, utterance, bin, CASE WHEN stddev_pop(a) * stddev_pop(b) * count(*) > 1e-12 THEN corr(a, b) END AS r FROM matched GROUP BY pair, utterance, bin)"""


_PARTS = f"{FRAMES}, u AS (SELECT y, x, row_number() OVER (PARTITION BY y ORDER BY frame) - 1 AS k FROM frames), parts AS MATERIALIZED (SELECT y, k // 30 AS utterance, k % 30 + 1 AS place, x FROM u)"
_WARPED = warped_sql("SELECT y AS pair, utterance, place, x FROM parts", "SELECT (y + 9) % 10 AS pair, utterance, place, x FROM parts")


@query(f"WITH RECURSIVE {_PARTS}, {_WARPED} SELECT n.pair, n.utterance, round(avg(bins.r), 6) AS r FROM n LEFT JOIN bins ON bins.pair = n.pair AND bins.utterance = n.utterance GROUP BY n.pair, n.utterance")
def dtw_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All utterances of a label, of thirty frames, against those of the same number of the next label; r is null where one has none."""
    f = frames.utterances(wide_frames(spark, sf_dir), "y").select(F.col("y").alias("pair"), "utterance", F.col("place").alias("frame"), F.col("x").alias("mel"))
    other = f.withColumn("pair", F.pmod(F.col("pair") - 1, F.lit(10))).withColumn("side", F.lit(1))
    found = dtw.warped_correlation(f.withColumn("side", F.lit(0)).unionByName(other), "pair", "utterance")
    return found.select("pair", "utterance", F.round("r", 6).alias("r"))
