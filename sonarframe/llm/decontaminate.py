"""Benchmark decontamination with an FM-index over each shard of the training texts.

A shard is a bounded slice of the documents of one task.  Its words are the symbols: the words that occur
in the benchmark have numbers, every other word ends a run, and a run that is shorter than the shortest
window cannot hold one, so only the other runs are indexed.  All windows of the benchmark walk backwards
through the index together; the rank queries go to a wavelet matrix over the Burrows-Wheeler transform.
Suffix positions are kept for every 16th word of a run, its first included, so that locating an occurrence
takes 15 steps at most and never leaves its run.  The occurrences of a document are merged to spans.

The benchmark goes out in blocks of about BLOCK_CHARS characters, each a broadcast of flat arrays, some five bytes a character; with
more than one block, the documents are numbered and written, read once for each block, and the spans of a row are merged after.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import small_batches, written
from .textbytes import ALNUM, combine, mix, slices, words

WINDOW = 13
SAMPLE = 16
SHARD_BYTES = 8 << 20
BLOCK_CHARS = 32 << 20
#: Windows that walk through an index together.
TOGETHER = 1 << 18


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.word = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.word[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks and symbols of a sequence, one bit vector for each bit of the symbols, highest first."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.shifts = range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1)
        self.levels: list[tuple[Bits, int]] = []
        for s in self.shifts:
            bit = (seq >> s) & 1 == 1
            self.levels.append((Bits(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols equal symbol."""
        start = np.zeros_like(i)
        for s, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            one = (symbol >> s) & 1 == 1
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for bits, zeros in self.levels:
            one, a = bits.get(i), bits.ones(i)
            symbol = symbol * 2 + one
            i = np.where(one, zeros + a, i - a)
        return symbol


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by doubling; the symbol 0 is smaller at earlier positions."""
    n = len(seq)
    ends = seq == 0
    n_ends = int(ends.sum())
    key = seq.astype(np.int64) + n_ends
    key[ends] = np.arange(n_ends)
    order = np.argsort(key, kind="stable")
    rank, step = np.empty(n, dtype=np.int64), 1

    def head(k: np.ndarray) -> np.ndarray:  # the first row of the group that each sorted row belongs to
        new = np.concatenate([[True], k[1:] != k[:-1]])
        return np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))

    rank[order] = head(key[order])
    while True:
        same = np.concatenate([rank[order][1:] == rank[order][:-1], [False]])
        same[1:] |= same[:-1].copy()
        rows = np.flatnonzero(same)
        if not len(rows):
            return order
        at = order[rows]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        base = rank[at]
        o = np.lexsort((after, base))
        at, base, after = at[o], base[o], after[o]
        order[rows] = at
        new = np.concatenate([[True], (base[1:] != base[:-1]) | (after[1:] != after[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, rows, 0))
        step *= 2


class FmIndex:
    """seq: runs of symbols from 1 to n_symbols - 1, a 0 before each run and at the end."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.n = len(seq)
        order = suffix_order(seq)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.tree = Wavelet(seq[order - 1], n_symbols)
        starts = np.flatnonzero(seq == 0)
        in_run = np.arange(self.n) - starts[np.searchsorted(starts, np.arange(self.n), side="right") - 1]
        marked = ((in_run % SAMPLE) == 1)[order]
        self.marks, self.sampled = Bits(marked), order[marked]

    def search(self, text: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length, by where they start in a text: the rows of the suffixes that begin with them, as (first, end)."""
        first = np.zeros(len(starts), dtype=np.int64)
        end = np.full(len(starts), self.n, dtype=np.int64)
        alive = np.arange(len(starts))
        for k in range(size - 1, -1, -1):
            c = text[starts[alive] + k].astype(np.int64)
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([first[alive], end[alive]]))
            first[alive], end[alive] = self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]
            alive = alive[first[alive] < end[alive]]
            if not len(alive):
                break
        dead = np.ones(len(starts), dtype=bool)
        dead[alive] = False
        end[dead] = first[dead]
        return first, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes."""
        out = np.empty(len(rows), dtype=np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            at = rows[left]
            found = self.marks.get(at)
            out[left[found]] = self.sampled[self.marks.ones(at[found])] + steps
            left, at = left[~found], at[~found]
            c = self.tree.access(at)
            rows[left] = self.less[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, ready for a search, in flat arrays.

    words: the numbers of all items' words; a window is a place in them.  groups has, for each length, the places of the
    distinct windows and the items that have them: those from ends[k] to ends[k + 1] of the last array have window k.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        texts = [(str(i), (t or "").encode()) for i, t in items if i is not None]
        data = np.frombuffer(b"".join(t for _, t in texts), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])]).astype(np.int64)
        hashes, _, first = words(data, offsets, ALNUM) if len(texts) else (np.zeros(0, np.uint64), None, np.zeros(1, np.int64))
        self.names = [i for i, _ in texts]
        self.vocabulary = np.unique(hashes)
        self.words = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int32)
        n = np.diff(first)
        length = np.minimum(n, window)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == size)
            count = n[own] - size + 1
            starts = (np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))).astype(np.int32)
            # equal windows are told by two hashes of their words
            a, b = hashes[starts], mix(hashes[starts])
            for k in range(1, size):
                a, b = combine(a, hashes[starts + k]), combine(b, ~hashes[starts + k])
            order = np.lexsort((b, a))
            new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
            ends = np.append(np.flatnonzero(new), len(order)).astype(np.int32)
            self.groups.append((size, starts[order[new]], ends, np.repeat(own, count)[order].astype(np.int32)))
        self.shortest = self.groups[0][0] if self.groups else 0

    @property
    def nbytes(self) -> int:
        return self.vocabulary.nbytes + self.words.nbytes + sum(x.nbytes for g in self.groups for x in g[1:])

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, Callable[[int], list[str]]]]:
        """For each length of phrases, and so many of them together: the first words of all occurrences, the length, which phrase each is, and what gives a phrase's items."""
        if not len(hashes) or not self.shortest:
            return
        number = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[number] == hashes
        begins = np.zeros(len(hashes) + 1, dtype=bool)
        begins[first] = True
        begins = begins[:-1]
        before = np.concatenate([[False], known[:-1]])
        starts = np.flatnonzero(known & (~before | begins))
        after = np.concatenate([known[1:], [False]])
        ends = np.flatnonzero(known & (~after | np.concatenate([begins[1:], [True]]))) + 1
        long = ends - starts >= self.shortest
        starts, size = starts[long], (ends - starts)[long]
        if not len(starts):
            return
        place = np.cumsum(size + 1) - size  # where each run begins, after its 0
        word_of = np.full(int(size.sum()) + len(size) + 1, -1, dtype=np.int64)
        inside = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        word_of[np.repeat(place - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = inside
        seq = np.where(word_of >= 0, number[np.maximum(word_of, 0)] + 1, 0)
        index = FmIndex(seq, len(self.vocabulary) + 1)
        for length, places, ends, items in self.groups:
            for lo in range(0, len(places), TOGETHER):
                begin, end = index.search(self.words, places[lo : lo + TOGETHER], length)
                hit = np.flatnonzero(begin < end)
                count = (end - begin)[hit]
                total = int(count.sum())
                if total:
                    rows = np.repeat(begin[hit] - np.cumsum(count) + count, count) + np.arange(total)
                    yield word_of[index.locate(rows)], length, np.repeat(hit + lo, count), lambda k, ends=ends, items=items: [self.names[i] for i in items[ends[k] : ends[k + 1]]]


def spans(documents: DataFrame, items: list[tuple], *keep: str, window: int = WINDOW) -> DataFrame:
    """Per row: the columns to keep, its number of words, merged spans of hit words (first and last), items with an occurring window."""
    sent = documents.sparkSession.sparkContext.broadcast(Phrases(items, window))
    fields = [f for f in documents.schema if f.name in keep]
    out = StructType.fromDDL("n_words long, spans array<struct<first:long,last:long>>, items array<string>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        of_spans, of_items = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "_text", limit=SHARD_BYTES):
                hashes, _, first = words(data, offsets, ALNUM)
                change = np.zeros(len(hashes) + 1, dtype=np.int64)
                found: dict[int, set[str]] = {}
                for at, size, which, names in phrases.occurrences(hashes, first):
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size, -1)
                    doc = np.searchsorted(first, at, side="right") - 1
                    for d, p in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                        found.setdefault(d, set()).update(names(p))
                hit = np.cumsum(change[:-1]) > 0
                rows: list[list[dict]] = [[] for _ in range(hi - lo)]
                for d in found:
                    own = np.concatenate([[False], hit[first[d] : first[d + 1]], [False]])
                    edges = np.flatnonzero(own[1:] != own[:-1]).tolist()
                    rows[d] = [{"first": a, "last": b - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(lo, hi - lo) for f in fields), pa.array(np.diff(first)), pa.array(rows, of_spans), pa.array([sorted(found.get(d, ())) for d in range(hi - lo)], of_items)], names=[*(f.name for f in fields), *out.names])

    return small_batches(documents.select(*(f.name for f in fields), F.col("text").cast("string").alias("_text"))).mapInArrow(scan, StructType([*fields, *out]))


def contamination(documents: DataFrame, benchmark: DataFrame, *keep: str, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns to keep, n_words, spans, items, n_hit, n_items, items_sha256, contaminated: a row for each row of documents.

    A null or empty text has no words and is clean; so is everything if the benchmark is empty.  Items
    without an id or words are left out.  Items that share a window all count.  Rows that repeat a doc_id, or
    have none, are rows of their own, however many blocks the benchmark has.
    """
    docs = documents.select(*keep, "text")
    bench = benchmark.select(F.col("item_id"), F.col("text").cast("string")).where("item_id is not null")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    if blocks == 1:
        found = spans(docs, bench.collect(), *keep, window=window)
    else:
        docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        found = None
        for k in range(blocks):
            part = spans(docs, bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect(), "_row", window=window)
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        merge = F.expr("""aggregate(array_sort(spans), cast(array() as array<struct<first:bigint,last:bigint>>), (a, s) ->
            CASE WHEN size(a) = 0 OR s.first > element_at(a, -1).last + 1 THEN concat(a, array(s))
            ELSE concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).first AS first, greatest(element_at(a, -1).last, s.last) AS last))) END)""")
        found = docs.drop("text").join(found.withColumn("spans", merge), "_row")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    found = found.withColumn("n_hit", n_hit)
    return found.select(
        *keep, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "spans", "items",
    )
