"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes, of contexts of up to ORDER bytes, with the counts of the bytes that
followed.  A byte is coded in the longest context that is known.  If it was seen there, its probability is its
share of the counts; else an escape, with the probability of method C (distinct bytes against counts), leads to the
context that is one byte shorter, where the bytes of the longer one are excluded, and so on down to the uniform
distribution over the bytes that were never seen.  A byte is thus reached in one way only, and what a context
gives to all bytes sums to 1 (but for the escape of a context in which every byte was seen).  The statistics are
frozen after training, so the code length of each byte is a function of the ORDER bytes before it, and what an
escape excludes is a number that each context keeps.  Each language's tree is whole: for each order, sorted arrays
of the contexts and of the (context, byte) pairs.  What is sent out grows with what the training documents hold,
of which there is a bounded number for each language, and with nothing else.  A text's exact code length in a
language is the sum over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import sized, small_batches, written
from .textbytes import slices

ORDER = 3
#: Training documents of each language, about: of more, those with the smallest hashes of doc_id are taken.
PER_LANGUAGE = 2000
#: Bits a byte from which a text is in none of the learned languages, and the least posterior probability.
FOREIGN_BITS, SURE = 6.5, 0.5
SLICE = 1 << 18
UNKNOWN = "und"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _mask(order: int) -> int:
    return (1 << 8 * (order + 1)) - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _starts(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(j, positions that have just j bytes before them in their text) for j below ORDER."""
    for j in range(ORDER):
        yield j, offsets[:-1][np.diff(offsets) > j] + j


def _grams(documents: DataFrame) -> DataFrame:
    """lang, gram (a byte and the ORDER before it as a number of base 256, 0 before the text) and how often."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                for _, _, data, offsets in slices(own, limit=SLICE):
                    gram, n = np.unique(_contexts(data, offsets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], schema=schema)

    return small_batches(documents.select("lang", "text")).mapInArrow(scan, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key, whether it is there)"""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Tree:
    """The tree of one language, from its grams and their counts.

    A level has, of each context, how many bytes followed it, its counts and escapes together, and what an escape
    from it excludes from these in the shorter context; and of each (context, byte) pair the count.  Both are
    sorted by the bytes as a number, so a context's pairs are neighbours.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            pairs, at = np.unique(gram & _mask(order), return_inverse=True)
            count = np.bincount(at, weights=n, minlength=len(pairs))
            contexts, at, kinds = np.unique(pairs >> 8, return_inverse=True, return_counts=True)
            whole = np.bincount(at, weights=count, minlength=len(contexts)) + kinds
            excluded = kinds + (np.bincount(at, weights=last[1][np.searchsorted(last[0], pairs & _mask(order - 1))], minlength=len(contexts)) if order else 0)
            self.levels.append((contexts.astype(np.uint32), kinds.astype(np.int16), whole, excluded, pairs.astype(np.uint32), count))
            last = pairs, count

    def bits(self, asked: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
        """Code length of the last byte of each gram after those before it; asked has the distinct ends of the grams for each order, and the place of each end's own end in the order below.

        escaped is the probability that the byte has in the shorter context once an escape from this one led there.
        """
        for (contexts, kinds, whole, excluded, pairs, count), (own, shorter) in zip(self.levels, asked, strict=True):
            context, known = _found(contexts, own >> np.uint32(8))
            pair, seen = _found(pairs, own)
            if shorter is None:
                p = escaped = np.full(len(own), 1 / max(1, 256 - int(kinds[0])))
            else:
                left = w[shorter] - excluded[context]  # 0 if the shorter context has no other byte: an escape goes through it
                escaped = np.where(left > 0, np.where(n[shorter] > 0, n[shorter], (d[shorter] - kinds[context]) * escaped[shorter]) / np.maximum(left, 1), escaped[shorter])
                p = p[shorter]
            n, d, w = np.where(seen, count[pair], 0.0), kinds[context].astype(float), whole[context]
            p = np.where(known, np.where(seen, n, d * escaped) / w, p)
        return -np.log2(p)


def _contexts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each byte, it and the ORDER before it in its text as a number of base 256, 0 before the text."""
    low = _LOWER[data].astype(np.int64)
    gram = low.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= low[: len(low) - k] << (8 * k)
    for j, at in _starts(offsets):
        gram[at] &= _mask(j)
    return gram


class Trees:
    """The frozen trees of all languages, from rows (lang, gram, n)."""

    def __init__(self, grams: list[tuple[str, int, int]] | pa.Table):
        columns = grams if isinstance(grams, pa.Table) else pa.table([pa.array(c, t) for c, t in zip(list(zip(*grams, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "gram", "n"])
        self.languages = sorted(columns["lang"].unique().to_pylist())
        self.trees = [Tree(own["gram"].to_numpy(), own["n"].to_numpy().astype(np.float64)) for own in (columns.filter(pc.equal(columns["lang"], x)) for x in self.languages)]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data) or not self.languages:
            return out
        grams, at = np.unique(_contexts(data, offsets), return_inverse=True)
        asked, own = [], grams.astype(np.uint32)
        for order in range(ORDER, 0, -1):
            ends, shorter = np.unique(own & np.uint32(_mask(order - 1)), return_inverse=True)
            asked.append((own, shorter))
            own = ends
        asked = [(own, None), *reversed(asked)]
        full = np.flatnonzero(np.diff(offsets))
        for k, tree in enumerate(self.trees):
            out[full, k] = np.add.reduceat(tree.bits(asked)[at], offsets[:-1][full])
        return out


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Trees:
    """Trees from the rows with a text and a lang; per_language bounds how many documents of each count."""
    known = documents.where("lang is not null and text is not null").select(F.col("doc_id"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    drawn = (F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000)) / 1_000_000) < F.least(F.lit(1.0), per_language / F.col("n"))
    grams = written(_grams(known.join(sized(counts), "lang").where(drawn)), "grams")
    return Trees(grams.toArrow())


def identify(documents: DataFrame, trees: Trees, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, lang_pred, score and bits (a byte, in the predicted language) per row.

    lang_pred is the language of the shortest code, the first in alphabetical order of equal ones; score is
    its posterior probability if all were as likely before.  A text that is null or has no letter, or any
    if no language was learned, is `und` with a score of 0.
    """
    sent = documents.sparkSession.sparkContext.broadcast(trees)
    fields = [f for f in documents.schema if f.name in keep]
    names = [*(f.name for f in fields), "lang_pred", "score", "bits"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        labels = pa.array([*trees.languages, UNKNOWN], pa.string())
        for batch in batches:
            letters = np.asarray(batch.column("_letters").to_numpy(zero_copy_only=False), dtype=bool)
            for lo, hi, data, offsets in slices(batch, "_text", SLICE):
                bits = trees.lengths(data, offsets)
                if trees.languages:
                    best = bits.argmin(1)
                    score = 1 / np.exp2(bits.min(1)[:, None] - bits).sum(1)
                    rate = bits.min(1) / np.maximum(np.diff(offsets), 1)
                else:
                    best, score, rate = (np.zeros(hi - lo, dtype=t) for t in (np.int64, float, float))
                known = letters[lo:hi] & bool(trees.languages)
                best, score = np.where(known, best, len(trees.languages)), np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(lo, hi - lo) for f in fields), labels.take(pa.array(best)), pa.array(score), pa.array(rate)], names=names)

    text = F.col("text").cast("string")
    marked = documents.select(*(f.name for f in fields), text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return small_batches(marked).mapInArrow(scan, StructType([*fields, *StructType.fromDDL("lang_pred string, score double, bits double")]))


def accepted(foreign_bits: float = FOREIGN_BITS, sure: float = SURE) -> Column:
    """Whether a row of identify() is in a learned language: it is not `und`, the posterior is clear and the code short."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= sure) & (F.col("bits") <= foreign_bits)
