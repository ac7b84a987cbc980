"""Quality from weak labels: heuristic labellers, a model of their accuracies, and a hashed scorer.

Each labeller votes good (1), bad (0) or abstains (-1) on a text.  Expectation-maximisation, on the counts of
vote patterns over the whole corpus, estimates how often each labeller is right on good and on bad texts and
how common those are; labellers are taken as independent given the quality.  The patterns' posteriors are
the soft labels of a sample that trains a linear scorer over hashed features of the text's words and shape,
which then scores every document, also where the labellers abstain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hashed import Ftrl, coordinate, scored, smallest, train
from .shared import small_batches, written
from .textbytes import NOT_SPACE, combine, mix, slices, words

#: Documents that train the scorer at most.
TRAINING = 12_000
PRIOR = 20.0


def distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different hashes each row has."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
    return np.bincount(row[order][new], minlength=len(first) - 1)


def statistics(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and numbers that the labellers look at; all are 0 for a null or empty text.

    Everything is counted over the bytes and words of whole texts.
    """
    fields = [f for f in documents.schema if f.name in keep]
    names = ["n_words", "n_bytes", "upper", "letters", "symbols", "spaces", "distinct", "next_same", "tokens_bare", "n_lines", "distinct_lines"]
    letter = np.zeros(256, dtype=bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    symbol = np.zeros(256, dtype=bool)
    symbol[33:127] = True
    symbol &= ~letter
    symbol[48:58] = False
    symbol[[39, 44, 46]] = False  # ' , .
    not_newline = np.ones(256, dtype=bool)
    not_newline[10] = False

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "_text"):
                h, start, first = words(data, offsets, NOT_SPACE)
                lines, _, line_first = words(data, offsets, not_newline)
                out = np.zeros((hi - lo, len(names)))
                out[:, 0], out[:, 1], out[:, 9] = np.diff(first), np.diff(offsets), np.diff(line_first)
                sums = {2: (data >= 65) & (data < 91), 3: letter[data], 4: symbol[data], 5: ~NOT_SPACE[data]}
                for k, flags in sums.items():
                    total = np.concatenate([[0], np.cumsum(flags)])
                    out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
                bare = np.concatenate([[0], np.cumsum(~letter[data[start]])]) if len(start) else np.zeros(1)
                out[:, 8] = bare[first[1:]] - bare[first[:-1]]
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                out[:, 6], out[:, 10] = distinct(h, first), distinct(lines, line_first)
                out[:, 7] = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(lo, hi - lo) for f in fields), *(pa.array(out[:, c]) for c in range(len(names)))], names=[*(f.name for f in fields), *names])

    schema = StructType([*fields, *StructType.fromDDL(", ".join(f"{n} double" for n in names))])
    return small_batches(documents.select(*(f.name for f in fields), F.col("text").cast("string").alias("_text"))).mapInArrow(scan, schema)


def votes() -> dict[str, Column]:
    """The labellers: 1 good, 0 bad, -1 abstains; each looks at another side of statistics()."""
    n, size, letters = (F.greatest(F.col(c), F.lit(1.0)) for c in ("n_words", "n_bytes", "letters"))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(bad, 0).when(good, 1).otherwise(-1).cast("int")

    capitals, symbols, repeats = F.col("upper") / letters, F.col("symbols") / size, F.col("distinct") / n
    length, lines = F.col("letters") / n, F.col("distinct_lines") / F.greatest(F.col("n_lines"), F.lit(1.0))
    return {
        "capitals": vote(capitals > 0.3, capitals < 0.12),
        "symbols": vote(symbols > 0.08, symbols < 0.02),
        "repeats": vote((repeats < 0.25) & (n < 1000) | (F.col("next_same") / n > 0.2), (F.col("next_same") / n < 0.05) & (repeats > 0.3)),
        "word_length": vote((length > 9) | (length < 2), (length >= 3) & (length <= 8)),
        "short_words": vote(F.col("tokens_bare") / n > 0.25, F.col("tokens_bare") / n < 0.08),
        "line_repeats": vote(lines < 0.6, lines > 0.9),
        "letters": vote(letters / size < 0.65, letters / size > 0.75),
    }


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """(share of good texts, P(vote | quality) as [labeller, quality, vote], posterior of each pattern).

    The start, which also counts as PRIOR texts of either quality, is that labellers speak against few good
    texts, each against its own kind of bad ones, and for most others; it settles which class is the good one.
    """
    if not counts:
        return 0.5, np.zeros((0, 2, 3)), {}
    patterns = np.array(list(counts), dtype=np.int64)
    n = np.array(list(counts.values()), dtype=np.float64)
    m = patterns.shape[1]
    onehot = np.stack([patterns == v for v in (0, 1, -1)], axis=2).astype(float)
    start = np.tile(np.array([[0.3, 0.6, 0.1], [0.005, 0.895, 0.1]]), (m, 1, 1))
    table = start
    good = 0.7
    for _ in range(rounds):
        log = np.einsum("pmv,mqv->pq", onehot, np.log(table)) + np.log([1 - good, good])
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        weight = np.stack([n * (1 - posterior), n * posterior])
        table = np.einsum("qp,pmv->mqv", weight, onehot) + PRIOR * start
        table /= table.sum(2, keepdims=True)
        good = float(np.clip((n * posterior).sum() / n.sum(), 1e-3, 1 - 1e-3))
    return good, table, {tuple(p): float(x) for p, x in zip(patterns.tolist(), posterior, strict=True)}


_CLASS = np.full(256, 3, dtype=np.uint64)  # 0 small, 1 capital, 2 digit, 3 other ASCII; the bytes of other letters count as small
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91], _CLASS[48:58] = 1, 2
_PAIR, _LINE, _SAME = (np.uint64(k) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words, and shares of hashed word shapes, of their neighbours, and of words and lines that repeat.

    A shape is the classes of a word's first and last byte and its length up to 16.  Shares are of the text's words.
    """
    h, start, first = words(data, offsets, NOT_SPACE, lower=False)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    if not len(h):
        return row, row, row.astype(float)
    ends = np.concatenate([start[1:], [len(data)]])
    last = np.maximum(start, ends - 1)
    blank = ~NOT_SPACE[data]
    real = np.maximum.accumulate(np.where(blank, -1, np.arange(len(data))))  # the last byte at or before that is of a word
    last = real[last]
    size = np.minimum(last - start + 1, 16).astype(np.uint64)
    shape = mix(_CLASS[data[start]] * np.uint64(4) + _CLASS[data[last]] + size * np.uint64(16) + np.uint64(1))
    share = 10.0 / n[row]
    inside = row[:-1] == row[1:]
    same = np.flatnonzero(inside & (h[:-1] == h[1:]))
    order = np.lexsort((h, row))
    again = order[1:][(row[order][1:] == row[order][:-1]) & (h[order][1:] == h[order][:-1])]
    parts = [
        (row, mix(h ^ _LINE), np.minimum(share / 10, 0.1)),
        (row, shape, share),
        (row[:-1][inside], combine(shape[:-1], shape[1:])[inside] ^ _PAIR, share[:-1][inside]),
        (row[same], np.full(len(same), mix(np.array([_SAME]))[0]), share[same]),
        (row[again], np.full(len(again), mix(np.array([_LINE]))[0]), share[again]),
    ]
    return tuple(np.concatenate(x) if k != 1 else coordinate(np.concatenate(x)) for k, x in enumerate(zip(*parts, strict=True)))


def quality(documents: DataFrame, most: int = TRAINING) -> DataFrame:
    """doc_id, score (probability of a good text) and kept (a score of 0.5 or more) per row of documents.

    A null or empty text gets bad votes only and the intercept's score; without rows the result is empty.
    Repeated rows each count.
    """
    labellers = votes()
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    voted = statistics(docs, "doc_id").select("doc_id", "n_words", *(v.alias(f"v_{k}") for k, v in labellers.items()))
    columns = [f"v_{k}" for k in labellers]
    counts = {tuple(r[:-1]): r[-1] for r in voted.groupBy(*columns).count().collect()}  # 3 ^ labellers rows at most
    _, _, posterior = estimate(counts)
    table = documents.sparkSession.createDataFrame([(",".join(map(str, p)), x) for p, x in posterior.items()], "pattern string, weak double")
    total = sum(counts.values())
    once = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # repeated rows are told apart, but for those alike in both, which are the same to learn from
    chosen = written(smallest(once, "key", most, total).drop("key"), "sample")
    sample = statistics(chosen, "doc_id", "text").select("doc_id", "text", pattern_of(labellers).alias("pattern"))
    weights = train(sample.join(F.broadcast(table), "pattern").select("doc_id", "text", F.col("weak").alias("target")), Ftrl(alpha=1.0, beta=1.0, l1=3.0, l2=0.1), shards=max(1, min(most, total) // 6000), features=features)
    return judged(documents, weights)


def pattern_of(labellers: dict[str, Column]) -> Column:
    return F.concat_ws(",", *(v.cast("string") for v in labellers.values()))


def judged(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    out = scored(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), weights, "doc_id", features=features)
    return out.withColumn("kept", F.col("score") >= 0.5)
