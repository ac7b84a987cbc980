"""Queries of correlations, ranks, rank tests and set-wise reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import experiment, frames, statistics
from ..sources.views import signal, spectrogram, table, wide_frames
from .registry import FRAMES, SIGNAL, SPEC, query

#: Original and reconstruction: a frame against the one before it.
_PAIR = f"{SPEC}, pair AS (SELECT a.frame, a.bin, a.v AS orig, b.v AS reco FROM spec a JOIN spec b ON b.frame = a.frame - 1 AND b.bin = a.bin)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = spectrogram(spark, sf_dir), spectrogram(spark, sf_dir)
    return a.withColumnRenamed("v", "orig").join(b.select((F.col("frame") + 1).alias("frame"), "bin", F.col("v").alias("reco")), ["frame", "bin"])


@query(f"WITH {_PAIR} SELECT bin, round(corr(orig, reco), 6) AS r FROM pair GROUP BY bin")
def pearson_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("bin").agg(F.round(statistics.pearson("orig", "reco"), 6).alias("r"))


@query(f"WITH {_PAIR}, r AS (SELECT bin, corr(orig, reco) AS r FROM pair GROUP BY bin) SELECT round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM r")
def pearson_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = statistics.by_bin(pairs(spark, sf_dir), "orig", "reco")
    return experiment.over_runs(r).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {_PAIR}, f AS (SELECT frame, ntile(10) OVER (ORDER BY frame) - 1 AS fold FROM (SELECT DISTINCT frame FROM pair)), r AS (SELECT fold, bin, corr(orig, reco) AS r FROM pair JOIN f USING (frame) GROUP BY fold, bin)
SELECT bin, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM r GROUP BY bin""")
def pearson_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("frame", F.col("frame") - 1)
    ids = frames.folds(p.select("frame").distinct(), 10)
    r = p.join(ids, "frame").groupBy("fold", "bin").agg(statistics.pearson("orig", "reco").alias("r"))
    return experiment.over_runs(r, "bin").select("bin", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""WITH {_PAIR}, t AS (SELECT frame // 10 AS trial, bin, corr(orig, reco) AS r FROM pair WHERE frame % 10 < 6 GROUP BY frame // 10, bin), m AS (SELECT trial, avg(r) AS r FROM t GROUP BY trial)
SELECT trial, round(r, 6) AS r FROM m ORDER BY r DESC, trial DESC LIMIT 5""")
def trial_pairs_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ten frames, of each the first six; the five trials that are reconstructed best."""
    p = pairs(spark, sf_dir).where("frame % 10 < 6").withColumn("trial", F.floor(F.col("frame") / 10).cast("bigint"))
    r = p.groupBy("trial", "bin").agg(statistics.pearson("orig", "reco").alias("r")).groupBy("trial").agg(F.avg("r").alias("r"))
    return experiment.shares_of_trials(r, 5).select("trial", F.round("r", 6).alias("r"))


_RHO = f"""{SPEC}, target AS (SELECT frame, avg(v) AS target FROM spec GROUP BY frame), ranked AS (SELECT bin, v, rank() OVER (PARTITION BY bin ORDER BY v) + (count(*) OVER (PARTITION BY bin, v) - 1) / 2.0e0 AS rx,
rank() OVER (PARTITION BY bin ORDER BY target) + (count(*) OVER (PARTITION BY bin, target) - 1) / 2.0e0 AS rt FROM spec JOIN target USING (frame)),
rho AS (SELECT bin AS feature, corr(rx, rt) AS rho FROM ranked GROUP BY bin)"""


def rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = statistics.target_ranks(wide_frames(spark, sf_dir).select("x", arrays.mean("x").alias("target")), "target", "rank")
    long = ranked.select("rank", F.posexplode("x").alias("feature", "v"))
    return statistics.spearman(long.withColumn("feature", F.col("feature").cast("bigint")), "feature", "v", "rank", ranked=True)


@query(f"WITH {_RHO} SELECT feature, round(rho, 6) AS rho FROM rho")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rho(spark, sf_dir).select("feature", F.round("rho", 6).alias("rho"))


@query(f"WITH {_RHO}, top AS (SELECT * FROM rho ORDER BY abs(rho) DESC, feature DESC LIMIT 20) SELECT row_number() OVER (ORDER BY abs(rho), feature) - 1 AS pos, feature FROM top")
def spearman_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.strongest(rho(spark, sf_dir), "feature", 20).select("pos", "feature")


@query(f"""WITH {SPEC}, g AS (SELECT bin, y < 5 AS a, rank() OVER (PARTITION BY bin ORDER BY v) + (count(*) OVER (PARTITION BY bin, v) - 1) / 2.0e0 AS r FROM spec JOIN frames USING (frame)),
s AS (SELECT bin, count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n2, sum(r) FILTER (a) AS r1 FROM g GROUP BY bin)
SELECT bin, n1, n2, r1 - n1 * (n1 + 1) / 2.0e0 AS u1, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0e0) AS u2 FROM s""")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = wide_frames(spark, sf_dir).select("y", F.posexplode("x").alias("bin", "v")).withColumn("bin", F.col("bin").cast("bigint"))
    return statistics.mann_whitney(long, "v", F.col("y") < 5, "bin").select("bin", "n1", "n2", "u1", "u2")


@query(f"""WITH {SPEC}, g AS (SELECT bin, v, y < 5 AS a, rank() OVER (PARTITION BY bin ORDER BY v) + (count(*) OVER (PARTITION BY bin, v) - 1) / 2.0e0 AS r FROM spec JOIN frames USING (frame)),
s AS (SELECT bin, count(*) FILTER (a)::DOUBLE AS n1, count(*) FILTER (NOT a)::DOUBLE AS n2, sum(r) FILTER (a) AS r1 FROM g GROUP BY bin), t AS (SELECT bin, sum(n * n * n - n) AS ties FROM (SELECT bin, count(*)::DOUBLE AS n FROM g GROUP BY bin, v) GROUP BY bin),
z AS (SELECT bin, greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5e0, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s JOIN t USING (bin)),
e AS (SELECT bin, z, z / sqrt(2.0e0) AS x, 1 / (1 + z / sqrt(2.0e0) / 2) AS t FROM z),
p AS (SELECT bin, z, least(t * exp(-x * x - 1.26551223e0 + t * (1.00002368e0 + t * (0.37409196e0 + t * (0.09678418e0 + t * (-0.18628806e0 + t * (0.27886807e0 + t * (-1.13520398e0 + t * (1.48851587e0 + t * (-0.82215223e0 + t * 0.17087277e0))))))))), 1) AS p FROM e)
SELECT bin, round(z, 6) AS z, round(p, 6) AS p, round(least(p * 64, 1), 6) AS p_corrected FROM p""")
def mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided probabilities, and corrected for the number of bins."""
    long = wide_frames(spark, sf_dir).select("y", F.posexplode("x").alias("bin", "v")).withColumn("bin", F.col("bin").cast("bigint"))
    found = statistics.mann_whitney(long, "v", F.col("y") < 5, "bin")
    return found.select("bin", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"), F.round(statistics.corrected("p", 64), 6).alias("p_corrected"))


@query(f"WITH {SPEC} SELECT a.bin AS i, b.bin AS j, round(covar_samp(a.v, b.v), 6) AS c FROM spec a JOIN spec b ON a.frame = b.frame GROUP BY a.bin, b.bin")
def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = statistics.covariance(wide_frames(spark, sf_dir), "x")
    rows = [(i, j, float(c[i, j])) for i in range(len(c)) for j in range(len(c))]
    return spark.createDataFrame(rows, "i bigint, j bigint, c double").select("i", "j", F.round("c", 6).alias("c"))


@query(f"WITH {SIGNAL} SELECT stream, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median FROM signal GROUP BY stream")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.summary(signal(spark, sf_dir), "v", "stream")
    return s.select("stream", *(F.round(c, 6).alias(c) for c in ("mean", "std", "median")))


@query(f"WITH {SPEC} SELECT bin, min(v) AS lo, max(v) AS hi FROM spec GROUP BY bin")
def bin_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrogram(spark, sf_dir).groupBy("bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("SELECT user_id AS stream, count(*) AS n, 86400.0e0 * 30 / count(*) AS interval FROM events GROUP BY user_id")
def stream_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and seconds from sample to sample of each stream over its 30 days."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stream")).agg(F.count("*").alias("n"), (F.lit(86400.0 * 30) / F.count("*")).alias("interval"))


@query(f"WITH {FRAMES} SELECT y, count(*) AS n FROM frames GROUP BY y")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_frames(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n"))
