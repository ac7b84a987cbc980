"""Queries on signals and markers: selection, joins through time, frames, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import experiment, frames, joins, select
from ..operators.staging import beside
from ..sources import sessions
from ..sources.views import signal, table, wide_frames
from .registry import FRAMES, SIGNAL, SPEC, query

#: The nominal rate of the events' signal: frames of 12 samples, a shift of 2.5.
SR = 250.0
#: Frames of a few samples make the energies; the thresholds of speech on them.
VOICED = {"context": 5, "share": 0.6, "threshold": 0.5, "scale": 1.0}


def seconds(ts: str | Column = "ts") -> Column:
    """Seconds since 1970 of a timestamp without a zone."""
    return (F.unix_micros(F.col(ts).cast("timestamp")) if isinstance(ts, str) else F.unix_micros(ts.cast("timestamp"))) / 1e6


SECONDS = "epoch_us(ts) / 1e6"


@query(f"WITH {SIGNAL} SELECT stream, idx, v FROM signal WHERE stream NOT IN (2, 3, 5, 7, 11)")
def channel_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.exclude_channels(signal(spark, sf_dir), [2, 3, 5, 7, 11], "stream").select("stream", "idx", "v")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '^(?:^Brand#1.$)') OR regexp_matches(p_brand, '^(?:^Brand#2|Brand#7$)')")
def channel_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_channels(table(spark, sf_dir, "part"), ["Brand#1.", "Brand#2|Brand#7"], "p_brand").select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT regexp_matches(p_brand, '^(?:^Brand#1.$)') AND NOT regexp_matches(p_brand, '^(?:^Brand#2|Brand#7$)')")
def channel_regex_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complement: the channels that no pattern names."""
    return table(spark, sf_dir, "part").where(~select.matches_any("p_brand", ["Brand#1.", "Brand#2|Brand#7"])).select("p_partkey", "p_brand")


@query(f"""WITH {SIGNAL}, a AS (SELECT stream, min(idx) AS s FROM signal WHERE label = 'signup' GROUP BY stream),
b AS (SELECT a.stream, a.s, (SELECT min(idx) FROM signal e WHERE e.stream = a.stream AND e.label = 'purchase' AND e.idx > a.s) AS e FROM a)
SELECT signal.stream, idx, v FROM signal JOIN b ON signal.stream = b.stream WHERE idx >= s AND (e IS NULL OR idx < e)""")
def crop_between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.crop_between(signal(spark, sf_dir), "signup", "purchase").select("stream", "idx", "v")


@query(f"""WITH {SIGNAL}, m AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY stream) AS us FROM signal)
SELECT stream, idx, round_even(us / 1e4, 0) / 100 AS seconds, trim(substring(label, 3)) AS word FROM m WHERE label LIKE 'pu%'""")
def marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.parse_markers(signal(spark, sf_dir), "pu").select("stream", "idx", "seconds", "word")


@query(f"WITH {SIGNAL} SELECT stream, idx, v FROM signal WHERE idx <= (SELECT min(m) FROM (SELECT max(idx) AS m FROM signal GROUP BY stream))")
def common_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.common_duration(signal(spark, sf_dir)).select("stream", "idx", "v")


@query(f"WITH {FRAMES} SELECT frame - 20 AS frame, y FROM frames WHERE frame >= 20 AND frame < (SELECT max(frame) + 1 FROM frames) - 4")
def lag_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.lag_align(wide_frames(spark, sf_dir)).select("frame", "y")


@query(f"WITH {FRAMES} SELECT frame, x[18] AS a, x[4] AS b, x[64] AS c FROM frames")
def column_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = wide_frames(spark, sf_dir).select("frame", select.pick("x", [17, 3, 63]).alias("p"))
    return chosen.select("frame", *(F.get("p", F.lit(k)).alias(c) for k, c in enumerate("abc")))


@query(f"WITH {SIGNAL} SELECT stream, idx, idx >= 20 AND idx < 32 AS test, NOT (idx >= 20 AND idx < 35) AS train FROM signal")
def trial_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test block of 12 samples from the 20th; training leaves out three samples more."""
    return signal(spark, sf_dir).select("stream", "idx", select.in_block("idx", 20, 12).alias("test"), (~select.in_block("idx", 20, 15)).alias("train"))


@query("SELECT event_id, ln(value - 20) AS x FROM events WHERE value > 20")
def nan_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms that are not numbers are taken out before statistics."""
    x = F.when(F.col("value") > 20, F.log(F.col("value") - 20)).otherwise(F.lit(float("nan")))
    return select.without_nan(table(spark, sf_dir, "events").select("event_id", x.alias("x")), "x").select("event_id", F.col("x"))


@query(f"""WITH {SIGNAL}, a AS (SELECT row_number() OVER (ORDER BY stream, idx) - 1 AS idx, v FROM signal), n AS (SELECT count(*) AS n FROM a),
b AS (SELECT vec_id AS idx, embedding[1]::DOUBLE AS v FROM embeddings)
SELECT idx, v FROM a UNION ALL SELECT idx + n, v FROM b, n""")
def stack_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recordings behind one another: all streams' samples, then the first bin of the frames."""
    one = select.end_to_end(signal(spark, sf_dir)).select("idx", "v")
    two = wide_frames(spark, sf_dir).select(F.col("frame").alias("idx"), F.get("x", F.lit(0)).alias("v"))
    return select.stack([one, two])


@query(f"""WITH {SIGNAL}, p AS (SELECT stream, event_id, {SECONDS} AS t FROM signal WHERE label = 'purchase'), g AS (SELECT stream, event_id AS gid, {SECONDS} AS gt FROM signal WHERE label = 'view'),
r AS (SELECT p.stream, p.event_id, p.t, gt, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - gt), gt) AS k FROM p LEFT JOIN g ON p.stream = g.stream)
SELECT stream, event_id, gt AS hit FROM r WHERE k = 1""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that is nearest to each purchase of a user; of two as near ones the earlier."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "event_id", F.col("event_type").alias("label"), seconds().alias("t"))
    return joins.nearest(s.where("label = 'purchase'").select("stream", "event_id", "t"), s.where("label = 'view'").select("stream", "t")).select("stream", "event_id", "hit")


@query(f"""WITH {SIGNAL}, s AS (SELECT stream, event_id, label, {SECONDS} AS t FROM signal), p AS (SELECT * FROM s WHERE label = 'purchase'),
r AS (SELECT p.stream, p.event_id, g.t AS via, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - g.t), g.t) AS k FROM p LEFT JOIN s g ON p.stream = g.stream AND g.label = 'view'),
q AS (SELECT r.stream, r.event_id, via, g.t AS hit, row_number() OVER (PARTITION BY r.event_id ORDER BY abs(via - g.t), g.t) AS k FROM r LEFT JOIN s g ON r.stream = g.stream AND g.label = 'click' WHERE r.k = 1)
SELECT stream, event_id, via, CASE WHEN via IS NOT NULL THEN hit END AS hit FROM q WHERE k = 1""")
def two_hop_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one clock to another and on to a third: purchase to view to click."""
    s = signal(spark, sf_dir).withColumn("t", seconds())
    grids = [s.where(F.col("label") == k).select("stream", "t") for k in ("view", "click")]
    return joins.two_hops(s.where("label = 'purchase'").select("stream", "event_id", "t"), *grids).select("stream", "event_id", "via", "hit")


def trials(s: DataFrame, length: int = 5) -> DataFrame:
    """Intervals of some samples from each signup."""
    return s.where("label = 'signup'").select("stream", F.col("idx").alias("first"), (F.col("idx") + length).alias("end"))


@query(f"WITH {SIGNAL} SELECT a.stream, a.idx, b.idx AS first, a.v FROM signal a JOIN signal b ON a.stream = b.stream AND b.label = 'signup' AND a.idx >= b.idx AND a.idx < b.idx + 5")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    return joins.in_intervals(s.select("stream", "idx", "v"), trials(s)).select("stream", "idx", "first", "v")


@query(f"WITH {SIGNAL} SELECT stream, idx, EXISTS (SELECT 1 FROM signal b WHERE b.stream = a.stream AND b.label = 'signup' AND a.idx >= b.idx AND a.idx < b.idx + 5) AS inside FROM signal a")
def interval_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    return joins.mask(s.select("stream", "idx"), trials(s))


@query("""WITH a AS (SELECT p_name AS word, min(p_partkey) AS first_a FROM part WHERE p_type = 'ECONOMY' GROUP BY p_name), b AS (SELECT p_name AS word, min(p_partkey) AS first_b FROM part WHERE p_type = 'PROMO' GROUP BY p_name)
SELECT word, first_a, first_b FROM a JOIN b USING (word)""")
def word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two sessions (the parts of two types) with where each has them first."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_name", "word")
    return joins.matching_words(p.where("p_type = 'ECONOMY'"), p.where("p_type = 'PROMO'"), "p_partkey")


@query("SELECT o_orderkey AS run, o_orderkey % 25 AS item, n_name AS word FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey")
def cycled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run with a training word, in turn."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"))
    words = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("item"), F.col("n_name").alias("word"))
    return joins.cycled(runs, words, 25).select("run", "item", "word")


# Frames of 12 samples: the k-th ends at round_even((10 k + 48) / 1000 * 250).
_FRAMED = f"""{SIGNAL}, lens AS (SELECT stream, max(idx) + 1 AS n FROM signal GROUP BY stream),
ends AS (SELECT stream, k AS frame, CASE WHEN k = 0 THEN 12 ELSE round_even((k * 10.0e0 + 12 / 250.0e0 * 1000) / 1000 * 250, 0)::BIGINT END AS e, n FROM lens, range(2000) r(k)),
framed AS (SELECT s.stream, frame, idx, v FROM ends JOIN signal s ON s.stream = ends.stream AND idx < e AND idx >= e - 12 WHERE e <= n)"""
_ENERGY = f"{_FRAMED}, energy AS (SELECT stream, frame, ln(sum(v * v) + 0.01e0) AS energy FROM framed GROUP BY stream, frame)"


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.log_energy(frames.framed(signal(spark, sf_dir), SR))


@query(f"WITH {_ENERGY} SELECT stream, frame, round(energy, 6) AS energy FROM energy")
def frame_log_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energies(spark, sf_dir).select("stream", "frame", F.round("energy", 6).alias("energy"))


_BATCH = f"""{SIGNAL}, lens AS (SELECT stream, max(idx) + 1 AS n FROM signal GROUP BY stream),
begins AS (SELECT stream, k AS frame, round_even(k * 2.5e0, 0)::BIGINT AS b FROM lens, range(2000) r(k) WHERE k < floor((n - 12.5e0) / 2.5e0) + 1),
framed AS (SELECT s.stream, frame, idx, v FROM begins JOIN signal s ON s.stream = begins.stream AND idx >= b AND idx < b + 12)"""


@query(f"WITH {_BATCH} SELECT stream, frame, round(ln(sum(v * v) + 0.01e0), 6) AS energy FROM framed GROUP BY stream, frame")
def frames_batch_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.log_energy(frames.batch_framed(signal(spark, sf_dir), SR)).select("stream", "frame", F.round("energy", 6).alias("energy"))


def _lags(value: str) -> str:
    return ", ".join(f"round(lag({value}, {5 * k}) OVER w, 6) AS f{4 - k}" if k else f"round({value}, 6) AS f4" for k in range(4, -1, -1))


def _features() -> list[Column]:
    return [F.round(F.get("features", F.lit(k)), 6).alias(f"f{k}") for k in range(5)]


@query(f"WITH {_ENERGY}, l AS (SELECT stream, frame, {_lags('energy')} FROM energy WINDOW w AS (PARTITION BY stream ORDER BY frame)) SELECT stream, frame, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3, f4 FROM l")
def stack_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.stacked(energies(spark, sf_dir)).select("stream", "frame", *_features())


@query(f"WITH {_ENERGY}, l AS (SELECT stream, frame, {_lags('energy')} FROM energy WINDOW w AS (PARTITION BY stream ORDER BY frame)) SELECT stream, frame - 20 AS frame, f0, f1, f2, f3, f4 FROM l WHERE frame >= 20")
def stack_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.stacked(energies(spark, sf_dir), pad=False).select("stream", "frame", *_features())


# The vote on samples: a sample counts above 0.5 + the stream's mean.
_VOTE = f"""{SIGNAL}, hot AS (SELECT stream, idx AS frame, (v > 0.5e0 + 1.0e0 * avg(v) OVER (PARTITION BY stream))::INT AS hot FROM signal),
vad AS (SELECT stream, frame, hot, sum(hot) OVER w >= count(*) OVER w * 0.6e0 AS voiced FROM hot WINDOW w AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
marked AS (SELECT *, sum(c) OVER (PARTITION BY stream ORDER BY frame) AS run FROM (SELECT *, CASE WHEN voiced = lag(voiced) OVER (PARTITION BY stream ORDER BY frame) THEN 0 ELSE 1 END AS c FROM vad)),
runs AS (SELECT stream, run, voiced, min(frame) AS first, max(frame) + 1 AS "end" FROM marked GROUP BY stream, run, voiced)"""


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.voiced(signal(spark, sf_dir).withColumnRenamed("idx", "frame"), "v", **VOICED)


@query(f"WITH {_VOTE} SELECT stream, frame, hot, voiced FROM vad")
def vad_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).select("stream", "frame", "hot", "voiced")


@query(f'WITH {_VOTE} SELECT stream, first, "end", voiced FROM runs')
def vad_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.runs(speech(spark, sf_dir), "voiced").select("stream", "first", "end", "voiced")


@query(f"WITH {_VOTE} SELECT stream, format('{{:.2f}}', first * 0.01e0) || chr(9) || format('{{:.2f}}', \"end\" * 0.01e0) || chr(9) || voiced::INT AS line FROM runs")
def vad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of label files: begin, end and 0 or 1."""
    from ..sources import labels

    return labels.interval_lines(frames.runs(speech(spark, sf_dir), "voiced"), "voiced").select("stream", "line")


@query(f"""WITH {_VOTE}, t AS (SELECT stream, idx AS first FROM signal WHERE label = 'signup'), lim AS (SELECT stream, min(first) AS lo, max(first) + 5 AS hi FROM t GROUP BY stream),
m AS (SELECT vad.stream, vad.frame, voiced AND coalesce(vad.frame >= lo AND vad.frame < hi, false) AS voiced, EXISTS (SELECT 1 FROM t WHERE t.stream = vad.stream AND vad.frame >= first AND vad.frame < first + 5) AS inside FROM vad LEFT JOIN lim USING (stream))
SELECT stream, count(*) FILTER (voiced AND inside) * 0.01e0 AS in_trials, count(*) FILTER (voiced AND NOT inside) * 0.01e0 AS in_rest FROM m GROUP BY stream""")
def speech_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stream the seconds of speech within trials and between them; before the first and after the last nothing counts."""
    from ..operators import experiment

    s = signal(spark, sf_dir)
    voiced = speech(spark, sf_dir).select("stream", F.col("frame").alias("idx"), "voiced")
    return experiment.speech_seconds(voiced, trials(s), 0.01)


@query(f"WITH {SPEC}, f AS (SELECT frame, ntile(10) OVER (ORDER BY frame) - 1 AS fold FROM frames) SELECT frame, fold FROM f")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.folds(wide_frames(spark, sf_dir), 10).select("frame", "fold")


@query(f"WITH {SIGNAL}, n AS (SELECT stream, count(*) AS n FROM signal GROUP BY stream) SELECT stream, ((idx - 17) % n + n) % n AS idx, v FROM signal JOIN n USING (stream)")
def circular_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir)
    return frames.rotated(beside(s, frames.lengths(s, "stream", "n"), ["stream"]), 17, F.col("n")).select("stream", "idx", "v")


@query(f"WITH {SIGNAL} SELECT stream, idx // 16 AS block, round(sum(v), 6) AS total, first(v ORDER BY idx) AS head, last(v ORDER BY idx) AS tail FROM signal GROUP BY stream, idx // 16 HAVING count(*) = 16")
def reblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 16 samples; an incomplete tail waits."""
    b = frames.blocks(signal(spark, sf_dir), 16)
    return b.select("stream", "block", F.round(arrays.total("block_values"), 6).alias("total"), F.get("block_values", F.lit(0)).alias("head"), F.get("block_values", F.lit(15)).alias("tail"))


@query(f"""WITH {SIGNAL}, b AS (SELECT stream, idx, idx // 16 AS block, v FROM signal), f AS (SELECT stream, block FROM b GROUP BY stream, block HAVING count(*) = 16)
SELECT b.stream, b.idx, b.v AS left_, 0.0e0 AS right_ FROM b JOIN f ON b.stream = f.stream AND b.block = f.block""")
def routed_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole blocks as samples on the left side, and silence on the right."""
    from ..sources import playback

    whole = playback.samples(frames.blocks(signal(spark, sf_dir), 16), 16)
    return playback.routed(whole, "left").select("stream", "idx", F.col("sides.left").alias("left_"), F.col("sides.right").alias("right_"))


@query(f"""WITH {SIGNAL}, n AS (SELECT stream, count(*) AS n FROM signal GROUP BY stream), grid AS (SELECT stream, unnest(range(n // 2 - 5)) AS idx FROM n WHERE n // 2 > 5),
t AS (SELECT stream, ceil(idx / 2.0e0)::BIGINT AS first FROM signal WHERE label = 'signup')
SELECT stream, idx, EXISTS (SELECT 1 FROM t WHERE t.stream = grid.stream AND idx >= first AND idx < first + 200) AS inside FROM grid""")
def trial_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 10 ms at 200 samples a second, and whether they are in the two seconds from a signup on."""
    s = signal(spark, sf_dir)
    sizes = s.groupBy("stream").agg(F.count("*").alias("n"))
    starts = s.where("label = 'signup'").select("stream", F.col("idx").alias("start"))
    return experiment.trial_mask(sizes, starts, 200)


@query(f"""WITH {SIGNAL}, s AS (SELECT stream, idx, v FROM signal), m AS (SELECT stream % 2 AS kind, max(idx) + 1 AS n FROM s GROUP BY stream % 2), least AS (SELECT min(n / CASE WHEN kind = 0 THEN 100.0e0 ELSE 250.0e0 END) AS sec FROM m)
SELECT stream, idx, v FROM s, least WHERE idx < floor(sec * CASE WHEN stream % 2 = 0 THEN 100 ELSE 250 END)""")
def common_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of streams, of 100 and of 250 samples a second, cut to the seconds that both have."""
    s = signal(spark, sf_dir).select(F.lit("one").alias("session"), (F.col("stream") % 2).alias("kind"), F.when(F.col("stream") % 2 == 0, 100).otherwise(250).alias("sr"), "stream", "idx", "v")
    return sessions.common_duration(s).select("stream", "idx", "v")


@query(f"""WITH {_FRAMED}, w AS (SELECT stream, frame * 3 + (row_number() OVER (PARTITION BY stream, frame ORDER BY idx) - 1) AS idx, v, 0.5e0 - 0.5e0 * cos(2 * pi() * row_number() OVER (PARTITION BY stream, frame ORDER BY idx) / 13) AS w FROM framed)
SELECT stream, idx, round(CASE WHEN sum(w) > 1e-12 THEN sum(v * w) / sum(w) ELSE 0 END, 6) AS v FROM w GROUP BY stream, idx""")
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames put back at a hop of three samples under a raised cosine."""
    from pyspark.sql import Window

    f = frames.framed(signal(spark, sf_dir), SR)
    k = F.row_number().over(Window.partitionBy("stream", "frame").orderBy("idx"))
    w = 0.5 - 0.5 * F.cos(2 * F.pi() * k / 13)
    placed = f.select("stream", "frame", (k - 1).cast("bigint").alias("offset"), w.alias("w"), "v").withColumn("y", F.col("v") * F.col("w"))
    return frames.overlap_added(placed, 3).select("stream", "idx", F.round("v", 6).alias("v"))


@query(f"""WITH {SIGNAL}, s AS (SELECT stream, idx, CASE WHEN label IN ('view', 'signup') THEN {SECONDS} END AS stamp FROM signal),
l AS (SELECT *, last(CASE WHEN stamp IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS li, last(stamp IGNORE NULLS) OVER w AS ls FROM s WINDOW w AS (PARTITION BY stream ORDER BY idx))
SELECT stream, idx, round(ls + (idx - li) / 100.0e0, 6) AS filled FROM l""")
def stamp_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signal(spark, sf_dir).withColumn("stamp", F.when(F.col("label").isin("view", "signup"), seconds()))
    return frames.stamps_filled(s, 100.0).select("stream", "idx", F.round("filled", 6).alias("filled"))


@query(f"""WITH {SIGNAL}, s AS (SELECT stream, idx, (epoch_us(ts) - 1704067200000000) / 1e6 AS t FROM signal), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY stream ORDER BY idx) > 36000 THEN 1 ELSE 0 END AS cut FROM s),
h AS (SELECT *, sum(cut) OVER (PARTITION BY stream ORDER BY idx)::BIGINT AS segment FROM g), m AS (SELECT *, avg(idx) OVER w AS mi, avg(t) OVER w AS mt FROM h WINDOW w AS (PARTITION BY stream, segment)),
q AS (SELECT *, sum((idx - mi) * (t - mt)) OVER w AS it, sum((idx - mi) * (idx - mi)) OVER w AS ii FROM m WINDOW w AS (PARTITION BY stream, segment))
SELECT stream, idx, segment, round(mt + CASE WHEN ii > 0 THEN it / ii ELSE 0 END * (idx - mi), 3) AS smooth FROM q""")
def dejitter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times on the least-squares line of their segment; a pause of ten hours begins a new one."""
    s = signal(spark, sf_dir).withColumn("t", (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6)
    return frames.dejittered(s, 36000.0).select("stream", "idx", "segment", F.round("smooth", 3).alias("smooth"))


@query(f"WITH {SIGNAL} SELECT stream, idx AS trial, label AS word, idx * 750 AS first FROM signal")
def trial_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of a session: the k-th word begins at three seconds times k."""
    from ..operators import experiment

    return experiment.trial_grid(signal(spark, sf_dir).select("stream", F.col("idx").alias("trial"), F.col("label").alias("word")), SR, 3.0)


@query(f"WITH {SIGNAL} SELECT stream, format('{{:.2f}}', idx * 3.0e0) || chr(9) || format('{{:.2f}}', idx * 3.0e0 + 2) || chr(9) || label AS line FROM signal")
def trial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import labels

    s = signal(spark, sf_dir).select("stream", (F.col("idx") * 3.0).alias("begin"), F.col("label").alias("word"))
    return labels.trial_lines(s, 2.0).select("stream", "line")


@query(f"WITH {SIGNAL} SELECT stream, idx // 32 AS chunk, count(*) AS samples FROM signal GROUP BY stream, idx // 32 HAVING count(*) = 32")
def replay_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that hands out 32 samples at a time; an incomplete chunk at the end is withheld."""
    from ..sources import replay

    return replay.chunked(signal(spark, sf_dir), 32).groupBy("stream", "chunk").agg(F.count("*").alias("samples"))


@query(f"WITH {SIGNAL} SELECT stream, idx, {SECONDS} + stream * 0.5e0 AS t FROM signal")
def clock_offset_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of each stream with its own constant correction."""
    return signal(spark, sf_dir).select("stream", "idx", (seconds() + F.col("stream") * 0.5).alias("t"))


@query("SELECT p_type FROM part INTERSECT SELECT DISTINCT p_type FROM part WHERE p_size > 25")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_type").intersect(p.where("p_size > 25").select("p_type"))


@query("SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 48")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_brand").subtract(p.where("p_size > 48").select("p_brand"))


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query(f"""WITH {SIGNAL}, s AS (SELECT *, row_number() OVER (ORDER BY v DESC, event_id DESC) AS k FROM signal) SELECT event_id, v FROM s WHERE k <= 5""")
def top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).orderBy(F.desc("v"), F.desc("event_id")).limit(5).select("event_id", "v")


@query(f"WITH {SIGNAL} SELECT stream, idx, 2 * v + 1 AS v FROM signal")
def mapped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function on each value; Arrow batches carry it."""
    from ..functions import udf

    return udf.mapped(signal(spark, sf_dir).select("stream", "idx", "v"), "v", lambda x: 2 * x + 1)


@query(f"WITH {SIGNAL}, c AS (SELECT stream, idx, v * 400 AS a FROM signal), d AS (SELECT *, CASE WHEN max(abs(a)) OVER () > 1 THEN a / 32768 ELSE a END AS b FROM c) SELECT stream, idx, round(CASE WHEN max(b) OVER () > 1 OR min(b) OVER () < -1 THEN b / 32768 ELSE b END, 9) AS v FROM d")
def audio_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in units of a 16-bit recording brought to -1 to 1; what is still outside is scaled again."""
    from ..operators import audio

    s = signal(spark, sf_dir).select("stream", "idx", (F.col("v") * 400).alias("v"))
    return audio.rescaled(s, integer=True).select("stream", "idx", F.round("v", 9).alias("v"))
