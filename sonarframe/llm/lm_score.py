"""Cross-entropy difference of two matched n-gram models.

A target and a background model are word bigram models, smoothed towards unigrams, over one vocabulary: all words
of either, the end of a text and one symbol for the unknown.  Both count alike, over all rows that belong to them,
and every word and every pair of words keeps its own count, under 64-bit hashes.  The larger model's counts are
scaled to the smaller one's number of words, so that both trust their counts alike and size does not tell
in the score.  With s the scale, n the counts, N their sum and V the size of the vocabulary,

    p(w) = (s n(w) + PRIOR) / (s N + PRIOR V),    p(w | c) = (s n(c, w) + HALF p(w)) / (s n(c) + HALF),

and each sums to 1 over the vocabulary.  A row that is part of a model is scored by the counts of the others: its own
are taken off.  A row's score is the mean, over its words and its end, of the log probability in the target model less
that in the background model: above 0, it is more like the target.

Counts stay distributed.  The rows are cut into slices; a slice sends its distinct keys, with its own
counts, to ranges of hashes, each range adds up what has come and answers every slice with the totals in
the order of the slice's keys.  No worker holds more than a range or a slice, and a frequent key is sent once a slice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import small_batches, written
from .textbytes import ALNUM, combine, mix, slices, words

#: Weight of a word's own probability in the smoothing, and the count at which a context weighs as much as it.
PRIOR, HALF = 0.5, 20.0
#: Bytes of text whose keys are made distinct together; a task has some 24 times as much in memory for it.
SLICE = 2 << 20
#: Ranges of keys there are at least (more with more shuffle partitions), and slices for each range: a slice of 2 MB has some 310,000 keys, so a range gets 1,240,000 at most however many slices there are, and has some 80 bytes for each.
PARTS, SLICES = 256, 4

_END = mix(np.array([0x2545F4914F6CDD1D], dtype=np.uint64))[0]


def _pack(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Integers byte by byte, which compresses well."""
    width = np.dtype(kind).itemsize
    return x.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes()


def _unpack(raw: bytes, kind: str = "<u8") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, whose first bytes are mostly zero."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


class Events:
    """What is predicted in a slice: each word, and the end of each text that has words.

    row and at: the row of each event and the places of those with a context; which and pair: places of the events' words and of the contexts' pairs in keys, the sorted distinct keys; those of pairs are odd.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        h, _, first = words(data, offsets, ALNUM)
        size = np.diff(first)
        self.n_words = size
        full = np.flatnonzero(size)
        own = np.insert(h, first[full + 1], _END)  # an end after the last word of each row
        self.row = np.repeat(np.arange(len(size)), size + (size > 0))
        self.at = np.flatnonzero(self.row[1:] == self.row[:-1]) + 1
        both = np.concatenate([own & ~np.uint64(1), combine(own[self.at - 1], own[self.at]) | np.uint64(1)])
        self.keys, place = np.unique(both, return_inverse=True)
        self.which, self.pair = place[: len(own)], place[len(own) :]

    def own(self, place: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each event's key is in the event's own row."""
        _, same, n = np.unique(row * max(len(self.keys), 1) + place, return_inverse=True, return_counts=True)
        return n[same]


def _cuts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """(number, where) of the ranges that sorted keys are in."""
    ends = np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(ends)):
        yield int(p), slice(ends[p], ends[p + 1])


def _text(column: pa.ChunkedArray | pa.Array) -> pa.RecordBatch:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.RecordBatch.from_arrays([column], names=["_text"])


def scored(documents: DataFrame, in_target: Column, *keep: str, in_background: Column | None = None) -> DataFrame:
    """The columns to keep, n_words and score per row of documents.

    in_target and in_background say of each row whether it belongs to a model (null: no; without
    in_background all rows belong to the background).  A text without words, or null, belongs to none and has
    a score of 0; so has every row if either model is empty.  Repeated rows each count and are scored
    by each other.  Without rows the result is empty.
    """
    fields = [f for f in documents.schema if f.name in keep]
    names = [f.name for f in fields]
    marks = ["_background", "_target"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the slices, and the rows in them."""
        for batch in batches:
            for lo, hi, _, _ in slices(batch, "_text", SLICE):
                number = [pa.array([uuid.uuid4().int >> 65] * (hi - lo), pa.int64()), pa.array(np.arange(hi - lo, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *number], names=[*names, "_text", *marks, "_slice", "_at"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of a slice that the task has: all of them, but for slices that a file's end cuts."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            number = table["_slice"].to_numpy()
            ends = np.flatnonzero(np.diff(number)) + 1 if len(number) else []
            for a, b in zip([0, *ends[:-1]], ends, strict=False):
                yield table.slice(a, b - a)
            rest = table.slice(ends[-1]) if len(ends) else table
        if rest is not None and len(rest):
            yield rest

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            (_, _, data, offsets), = slices(_text(run["_text"]), "_text", 1 << 62)
            e = Events(data, offsets)
            member = [np.asarray(run[m].to_numpy(), dtype=bool)[e.row] for m in marks]
            n = [np.bincount(e.which, weights=m, minlength=len(e.keys)) + np.bincount(e.pair, weights=m[e.at], minlength=len(e.keys)) for m in member]
            found = [(run["_slice"][0].as_py(), run["_at"][0].as_py(), len(run), p, _pack_sorted(e.keys[w]), *(_pack(x[w], "<u4") for x in n)) for p, w in _cuts(e.keys, parts)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 3], strict=True)], names=["_slice", "_at", "rows", "part", "keys", "background", "target"])
            del e, member, n, found  # not kept while the next slice is worked on

    def answer(asked: pa.Table) -> pa.Table:
        keys, place = np.unique(np.concatenate([_unpack_sorted(k) for k in asked["keys"].to_pylist()]), return_inverse=True)
        total = [np.bincount(place, weights=np.concatenate([_unpack(x, "<u4") for x in asked[c].to_pylist()]), minlength=len(keys)) for c in ("background", "target")]
        word = keys & np.uint64(1) == 0
        ends = np.cumsum([0, *(len(k) // 8 for k in asked["keys"].to_pylist())])
        known = (total[0] + total[1])[word] > 0
        of_part = [[int(known.sum())], *([int(x[word].sum())] for x in total)]
        return pa.table([*(asked[c] for c in ("_slice", "_at", "rows", "part")), *(pa.array([_pack(x[place[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in total), *(pa.array(x + [0] * (len(asked) - 1), pa.int64()) for x in of_part)],
                        names=["_slice", "_at", "rows", "part", "background", "target", "kinds", "n_background", "n_target"])

    text = F.col("text").cast("string").alias("_text")
    member = [F.coalesce(F.lit(True) if m is None else m, F.lit(False)).alias(c) for m, c in zip((in_background, in_target), marks, strict=True)]
    docs = written(small_batches(documents.select(*names, text, *member)).mapInArrow(cut, StructType([*fields, *StructType.fromDDL("_text string, _background boolean, _target boolean, _slice long, _at int")])), "sliced")
    parts = max(PARTS, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.select("_slice").distinct().count() // SLICES)
    asked = docs.select("_text", *marks, "_slice", "_at").mapInArrow(ask, "_slice long, _at int, rows int, part int, keys binary, background binary, target binary")
    answers = written(asked.groupBy("part").applyInArrow(answer, "_slice long, _at int, rows int, part int, background binary, target binary, kinds long, n_background long, n_target long"), "answers")
    kinds, *n = (float(x) for x in answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("kinds", "n_background", "n_target"))).first())
    scale = [min(n) / x if x else 0.0 for x in n]
    size = kinds + 1  # one for what neither model has

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers = texts.sort_by("_at"), answers.sort_by([("_at", "ascending"), ("part", "ascending")])
        n_words, mean = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        at = texts["_at"].to_numpy()
        begins = answers["_at"].to_numpy()
        for begin in np.unique(begins):
            mine = answers.filter(pa.array(begins == begin))
            lo = int(np.searchsorted(at, begin))
            run = texts.slice(lo, mine["rows"][0].as_py())
            (_, _, data, offsets), = slices(_text(run["_text"]), "_text", 1 << 62)
            e = Events(data, offsets)
            own, own_pair = e.own(e.which, e.row), e.own(e.pair, e.row[e.at])
            length = np.bincount(e.row, minlength=len(run))
            log = []
            for k, c in enumerate(("background", "target")):
                total = np.concatenate([_unpack(x) for x in mine[c].to_pylist()]).astype(np.float64)
                inside = np.asarray(run[marks[k]].to_numpy(), dtype=np.float64)[e.row]
                seen = scale[k] * (total[e.which] - own * inside)
                p = (seen + PRIOR) / (scale[k] * (n[k] - length[e.row] * inside) + PRIOR * size)
                together = scale[k] * (total[e.pair] - own_pair * inside[e.at])
                p[e.at] = (together + HALF * p[e.at]) / (seen[e.at - 1] + HALF)
                log.append(np.log(p))
            n_words[lo : lo + len(run)] = e.n_words
            mean[lo : lo + len(run)] = np.bincount(e.row, weights=log[1] - log[0], minlength=len(run)) / np.maximum(length, 1)
        return pa.table([*(texts[f] for f in names), pa.array(n_words), pa.array(mean if min(n) else np.zeros(len(texts)))], names=[*names, "n_words", "score"])

    return docs.groupBy("_slice").cogroup(answers.select("_slice", "_at", "rows", "part", "background", "target").groupBy("_slice")).applyInArrow(score, StructType([*fields, *StructType.fromDDL("n_words long, score double")]))
