"""Queries on spectrogram frames: codebooks, mel scales, transforms, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, filters, mel
from ..operators import audio, filtering, frames, quantize, vocoder
from ..sources.views import signal, spectrogram, wide_frames
from .registry import FRAMES, SIGNAL, SPEC, cascade_sql, query

LEVELS = 9
#: The embeddings' 64 numbers as a spectrum of a signal of 16 kHz, and its mel filters.
BINS, MELS, SR = 64, 16, 16000.0


def unnested(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias(name, "v")).select(*keys, F.col(name).cast("bigint").alias(name), F.round("v", 6).alias("v"))


_BOOK = f"""{SPEC}, ranges AS (SELECT bin, min(v) AS lo, max(v) AS hi FROM spec GROUP BY bin),
book AS (SELECT bin, k AS level, CASE WHEN k < 8 THEN (abs(lo) + hi) / (1 + exp(-0.5e0 * (-10 + (k + 1) * (20 / 9.0e0)))) - abs(lo) ELSE hi END AS border,
(abs(lo) + hi) / (1 + exp(-0.5e0 * (-9.5e0 + k * (19 / 8.0e0)))) - abs(lo) AS median FROM ranges, range(9) r(k)),
levels AS (SELECT frame, spec.bin, v, coalesce(min(level) FILTER (v <= border), 0) AS level FROM spec JOIN book ON spec.bin = book.bin GROUP BY frame, spec.bin, v),
deq AS (SELECT frame, levels.bin, levels.level, median AS v FROM levels JOIN book ON levels.bin = book.bin AND levels.level = book.level)"""


@query(f"WITH {_BOOK} SELECT bin, level, round(border, 6) AS border, round(median, 6) AS median FROM book")
def codebook_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quantize.logistic_codebook(spectrogram(spark, sf_dir), LEVELS)
    both = book.select("bin", F.posexplode(F.arrays_zip("borders", "medians")).alias("level", "_p"))
    return both.select("bin", F.col("level").cast("bigint").alias("level"), F.round("_p.borders", 6).alias("border"), F.round("_p.medians", 6).alias("median"))


def coded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spec = spectrogram(spark, sf_dir)
    book = quantize.logistic_codebook(spec, LEVELS)
    return quantize.quantised(spec, book), book


@query(f"WITH {_BOOK} SELECT frame, bin, level FROM levels")
def quantize_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir)[0].select("frame", "bin", "level")


@query(f"WITH {_BOOK} SELECT frame, bin, round(v, 6) AS v FROM deq")
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, book = coded(spark, sf_dir)
    return quantize.dequantised(levels.drop("v"), book).select("frame", "bin", F.round("v", 6).alias("v"))


_TAPS = arrays.gaussian(0.5)
_MIRROR = "CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} > 63 THEN 127 - ({i}) ELSE {i} END"


@query(f"""WITH {_BOOK}, taps AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest({_TAPS}::DOUBLE[]) AS w)
SELECT a.frame, a.bin, round(sum(b.v * w), 6) AS v FROM deq a, taps JOIN deq b ON b.frame = a.frame AND b.bin = {_MIRROR.format(i='a.bin + d')} GROUP BY a.frame, a.bin""")
def dequantize_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, book = coded(spark, sf_dir)
    return unnested(quantize.smoothed_frames(quantize.dequantised(levels.drop("v"), book)), ["frame"], "mel", "bin")


@query(f"WITH {FRAMES} SELECT frame, k AS level, (k = y)::DOUBLE AS v FROM frames, range(10) r(k)")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(wide_frames(spark, sf_dir).withColumn("h", arrays.one_hot("y", 10)), ["frame"], "h", "level")


@query(f"WITH {_BOOK} SELECT bin, level FROM book EXCEPT SELECT bin, level FROM levels")
def missing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.missing_levels(coded(spark, sf_dir)[0], LEVELS)


@query(f"""WITH RECURSIVE {SPEC}, sorted AS MATERIALIZED (SELECT bin, list(v ORDER BY v) AS l FROM spec GROUP BY bin),
cut AS (SELECT bin, l, [{{'size': len(l), 'a': 0::BIGINT, 'b': len(l)}}] AS spans, 1 AS k FROM sorted
UNION ALL SELECT bin, l, CASE WHEN upto < last.b THEN rest || [{{'size': upto - last.a, 'a': last.a, 'b': upto}}, {{'size': last.b - upto, 'a': upto, 'b': last.b}}] ELSE rest || [{{'size': 0::BIGINT, 'a': last.a, 'b': last.b}}] END, k + 1
FROM (SELECT *, len(list_filter(l, lambda x: x <= l[last.a + last.size // 2 + 1])) AS upto
FROM (SELECT bin, l, k, list_transform(ordered[:-2], lambda s: {{'size': s.size, 'a': s.a, 'b': s.b}}) AS rest, ordered[-1] AS last
FROM (SELECT *, list_sort(list_transform(spans, lambda s, i: {{'size': s.size, 'i': i, 'a': s.a, 'b': s.b}})) AS ordered FROM cut WHERE k < {LEVELS})))),
ends AS (SELECT bin, l, list_sort(list_transform(spans, lambda s: {{'a': s.a, 'b': s.b}})) AS s FROM cut WHERE k = {LEVELS})
SELECT bin, list_transform(s, lambda x: l[x.b]) AS borders, list_transform(s, lambda x: (l[x.a + (x.b - x.a - 1) // 2 + 1] + l[x.a + (x.b - x.a) // 2 + 1]) / 2) AS medians FROM ends""")
def codebook_median_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.median_cut_codebook(spectrogram(spark, sf_dir), LEVELS)


_MEL = f"""step AS (SELECT 2595.0e0 * log10(1.0e0 + 8000.0e0 / 700.0e0) / {MELS + 1} AS s), edges AS (SELECT i, floor(floor(700.0e0 * (pow(10.0e0, i * s / 2595.0e0) - 1.0e0)) / 8000.0e0 * {BINS})::BIGINT AS e FROM step, range({MELS + 2}) r(i)),
tri AS (SELECT a.i AS filter, k AS bin, CASE WHEN k >= a.e AND k < b.e THEN (k - a.e) / greatest(b.e - a.e, 1)::DOUBLE WHEN k >= b.e AND k < c.e THEN (c.e - k) / greatest(c.e - b.e, 1)::DOUBLE ELSE 0 END AS w FROM edges a JOIN edges b ON b.i = a.i + 1 JOIN edges c ON c.i = a.i + 2, range({BINS}) r(k)),
mel AS (SELECT filter, bin, coalesce(w / nullif(sum(w) OVER (PARTITION BY filter), 0), 0) AS w FROM tri),
inv AS (SELECT filter, bin, coalesce(w / nullif(sum(w) OVER (PARTITION BY bin), 0), 0) AS w FROM mel)"""


@query(f"WITH {_MEL} SELECT m.filter, m.bin, round(m.w, 9) AS w, round(i.w, 9) AS back FROM mel m JOIN inv i ON m.filter = i.filter AND m.bin = i.bin")
def mel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, inv = mel.matrix(BINS, MELS, SR), mel.inverse(BINS, MELS, SR)
    rows = [(i, k, round(float(m[i, k]), 9), round(float(inv[k, i]), 9)) for i in range(MELS) for k in range(BINS)]
    return spark.createDataFrame(rows, "filter bigint, bin bigint, w double, back double")


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_frames(spark, sf_dir).select("frame", F.transform("x", lambda v: F.abs(v)).alias("spectrum"))


_LOG_MELS = f"{SPEC}, {_MEL}, logmel AS (SELECT frame, filter, ln(sum(abs(v) * w) + 1e-7) AS v FROM spec JOIN mel ON spec.bin = mel.bin GROUP BY frame, filter)"


@query(f"WITH {_LOG_MELS} SELECT frame, filter, round(v, 6) AS v FROM logmel")
def log_mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(spectrum(spark, sf_dir).withColumn("m", mel.to_log_mels("spectrum", mel.matrix(BINS, MELS, SR))), ["frame"], "m", "filter")


@query(f"WITH {_LOG_MELS} SELECT frame, bin, round(sum(exp(v) * w), 6) AS v FROM logmel JOIN inv ON logmel.filter = inv.filter GROUP BY frame, bin")
def from_log_mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = spectrum(spark, sf_dir).withColumn("m", mel.to_log_mels("spectrum", mel.matrix(BINS, MELS, SR)))
    return unnested(logs.withColumn("back", mel.from_log_mels("m", mel.inverse(BINS, MELS, SR))), ["frame"], "back", "bin")


@query(f"WITH {SPEC} SELECT frame, k, round(sum(2 * v * cos(pi() * k * (2 * bin + 1) / (2 * {BINS}))), 6) AS v FROM spec, range(15) r(k) GROUP BY frame, k")
def dct2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnested(wide_frames(spark, sf_dir).withColumn("d", arrays.dct2("x", BINS, 15)), ["frame"], "d", "k")


@query(f"""WITH {SPEC}, w AS (SELECT frame, bin, v * (0.5e0 - 0.5e0 * cos(2 * pi() * bin / 63)) AS v FROM spec)
SELECT frame, k AS bin, round(sqrt(pow(sum(v * cos(2 * pi() * k * bin / 64)), 2) + pow(sum(v * sin(2 * pi() * k * bin / 64)), 2)), 6) AS v FROM w, range(33) r(k) GROUP BY frame, k""")
def dft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of each frame's numbers, taken as 64 samples under a Hann window."""
    return unnested(audio.magnitudes(wide_frames(spark, sf_dir).select("frame", "x")), ["frame"], "magnitude", "bin")


@query(f"""WITH {_LOG_MELS}, c0 AS (SELECT frame, 2 * sum(v) AS e FROM logmel GROUP BY frame), hot AS (SELECT frame, (e > -20.0e0 + 1.0e0 * avg(e) OVER ())::INT AS hot FROM c0)
SELECT frame, hot, sum(hot) OVER w >= count(*) OVER w * 0.6e0 AS voiced FROM hot WINDOW w AS (ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")
def vad_log_mels(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = spectrum(spark, sf_dir).select("frame", F.lit(0).alias("stream"), mel.to_log_mels("spectrum", mel.matrix(BINS, MELS, SR)).alias("mel"))
    return audio.voiced_from_log_mels(logs, MELS, threshold=-20.0).select("frame", "hot", "voiced")


@query(f"""WITH RECURSIVE {SIGNAL}, y AS (SELECT stream, idx, 0.1e0 * v AS v FROM signal WHERE idx = 0 UNION ALL SELECT s.stream, s.idx, 0.1e0 * s.v + 0.9e0 * y.v FROM y JOIN signal s ON s.stream = y.stream AND s.idx = y.idx + 1) SELECT stream, idx, round(v + 3.14159265e-10, 6) AS v FROM y""")
def iir_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values have few decimals, so some lie between two roundings; a little is added to all, which moves them away."""
    return filtering.first_order(signal(spark, sf_dir), 0.9).select("stream", "idx", F.round(F.col("v") + 3.14159265e-10, 6).alias("v"))


_SOS = filters.butterworth(2, "low", (40.0,), 250.0)[0].tolist()


@query(f"""WITH RECURSIVE {SIGNAL}, y AS (SELECT stream, idx, v AS x1, 0.0e0 AS x2, {_SOS[0]!r}::DOUBLE * v AS y, 0.0e0 AS y1 FROM signal WHERE idx = 0
UNION ALL SELECT s.stream, s.idx, s.v, y.x1, {_SOS[0]!r}::DOUBLE * s.v + {_SOS[1]!r}::DOUBLE * y.x1 + {_SOS[2]!r}::DOUBLE * y.x2 - {_SOS[4]!r}::DOUBLE * y.y - {_SOS[5]!r}::DOUBLE * y.y1, y.y FROM y JOIN signal s ON s.stream = y.stream AND s.idx = y.idx + 1)
SELECT stream, idx, round(y, 6) AS v FROM y""")
def sos_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section of two poles from rest, in chunks of 16 samples whose states are put together."""
    s = signal(spark, sf_dir).select("stream", "idx", "v")
    return filtering.filtered(s, filters.butterworth(2, "low", (40.0,), 250.0), start="rest", chunk=16).select("stream", "idx", F.round("v", 6).alias("v"))


def high_gamma_sql(sr: float, zeros: int) -> str:
    """CTEs of which the last, high_gamma (stream, idx, v), is filtering.high_gamma() of signal."""
    stages = filters.high_gamma(sr)
    starts = [filters.steady_state(s) if k < len(stages) - 1 else filters.warm(s, 1, zeros)[:, :, 0] for k, s in enumerate(stages)]
    kinds = ["cold"] * (len(stages) - 1) + ["warm"]
    return cascade_sql("signal", [(s.tolist(), kind) for s, kind in zip(stages, kinds, strict=True)], [x.tolist() for x in starts], "high_gamma")


@query(f"WITH RECURSIVE {SIGNAL.replace('AS (', 'AS MATERIALIZED (', 1)}, {high_gamma_sql(1024.0, 41)} SELECT stream, idx, round(v, 5) AS v FROM high_gamma")
def high_gamma_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.high_gamma(signal(spark, sf_dir).select("stream", "idx", "v"), 1024.0, zeros=41).select("stream", "idx", F.round("v", 5).alias("v"))


_LOW = filters.butterworth(8, "low", (0.8 * 48000.0 / 2 / 3,), 48000.0)
_LOW_STAGE = [(_LOW.tolist(), "cold")]
_LOW_START = [filters.steady_state(_LOW).tolist()]


@query(f"""WITH RECURSIVE {SIGNAL.replace('AS (', 'AS MATERIALIZED (', 1)}, {cascade_sql("signal", _LOW_STAGE, _LOW_START, "forth")}, n AS (SELECT stream, max(idx) AS last FROM signal GROUP BY stream),
turned AS MATERIALIZED (SELECT stream, last - idx AS idx, v FROM forth JOIN n USING (stream)), {cascade_sql("turned", _LOW_STAGE, _LOW_START, "back")}
SELECT stream, (last - idx) // 3 AS idx, round(v, 5) AS v FROM back JOIN n USING (stream) WHERE (last - idx) % 3 = 0""")
def decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.decimated(signal(spark, sf_dir), 3, 48000.0).select("stream", "idx", F.round("v", 5).alias("v"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-mel frames of utterances: a hundred frames of the same label each, in their order."""
    logs = spectrum(spark, sf_dir).join(wide_frames(spark, sf_dir).select("frame", "y"), "frame")
    parts = frames.utterances(logs, "y", 100)
    return parts.select(F.concat_ws("-", F.col("y").cast("string"), F.col("utterance").cast("string")).alias("stream"), F.col("place").cast("bigint").alias("frame"), mel.to_log_mels("spectrum", mel.matrix(BINS, MELS, SR)).alias("mel"))


@query()
def griffin_lim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocoder.griffin_lim(utterances(spark, sf_dir))


@query()
def griffin_lim_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocoder.griffin_lim(utterances(spark, sf_dir), streaming=True)


@query(f"""WITH {SIGNAL}, n AS (SELECT stream, max(idx) + 1 AS n FROM signal GROUP BY stream), f AS (SELECT stream, k AS frame, t FROM n, range(500) r(k), range(16) q(t) WHERE k * 4 + 16 <= n + 12),
w AS (SELECT f.stream, f.frame, t, coalesce(v, 0) * (0.5e0 - 0.5e0 * cos(2 * pi() * t / 15)) AS v FROM f LEFT JOIN signal s ON s.stream = f.stream AND s.idx = f.frame * 4 + t - 12)
SELECT stream, frame, k AS bin, round(sqrt(pow(sum(v * cos(2 * pi() * k * t / 16)), 2) + pow(sum(v * sin(2 * pi() * k * t / 16)), 2)), 5) AS v FROM w, range(9) r(k) GROUP BY stream, frame, k""")
def stft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 samples every 4 samples, with 12 zeros before the first sample."""
    w = audio.windows(signal(spark, sf_dir).select("stream", "idx", "v"), 16, 4, lead=12)
    m = audio.magnitudes(w).select("stream", "frame", F.posexplode("magnitude").alias("bin", "v"))
    return m.select("stream", "frame", F.col("bin").cast("bigint").alias("bin"), F.round("v", 5).alias("v"))

