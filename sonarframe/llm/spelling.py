"""Spelling variants by a symmetric-delete join.

Every word emits itself and each of its distinct single deletions as keys.  Two words that differ by one inserted,
deleted or replaced character share a key: the shorter word itself, or what both are without the replaced
character.  An equi-join on the keys gives the candidates, and their exact distance decides.

A key is a 64-bit hash of its characters and their number.  As a polynomial in the characters, the hash without the
i-th one follows from sums over what is before and after it, so a word's keys take time and memory in proportion to
its length, however long it is; what meets by chance fails the exact test.  Deleting any character of a run of equal
ones gives the same key, which is emitted once.  How many words share a key is bounded by the letters there are and
by the word's length, not by the corpus: words are counted before anything else.

A variant's form is the most frequent near word, if it is frequent enough beside it.  Forms are followed
to the last by joins that double the steps taken each time; as counts grow along them, there are no circles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import delete, written
from .textbytes import combine, mix, slices

LETTERS = "A-Za-zÀ-ÿ"
#: Fewest characters, and fewest occurrences, of a word.
LEAST, OFTEN = 7, 2
#: So many times as frequent as a variant its form is.
TIMES = 10

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: An odd number, so it has an inverse among 64-bit integers.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def runs(documents: DataFrame, *keep: str, least: int = LEAST) -> DataFrame:
    """The columns to keep and run, lower-cased: each longest run of letters, of `least` letters or more, in the texts."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return documents.where("text is not null").select(*keep, F.explode(found).alias("run")).withColumn("run", lowered(F.col("run")))


def counted(words: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word and n of the words, a row for each occurrence, that are long and frequent enough; null is no word."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def deletion_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which word, key) of all keys of words in UTF-8: the word itself, and it without each of its characters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    size = np.diff(first)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(points)) - first[word]
    with np.errstate(over="ignore"):
        power = np.full(max(1, int(size.max(initial=0))), _BASE, dtype=np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points) * power[place])])
        own = total[first[1:]] - total[first[:-1]]
        # a run of equal characters is left out at its first one
        new = np.concatenate([[True], (points[1:] != points[:-1]) | (word[1:] != word[:-1])])[: len(points)]
        at, word = np.flatnonzero(new), word[new]
        without = (total[at] - total[first[word]]) + (total[first[word + 1]] - total[at + 1]) * _INVERSE
        return np.concatenate([np.arange(len(size)), word]), np.concatenate([combine(own, size.astype(np.uint64)), combine(without, (size[word] - 1).astype(np.uint64))])


def keyed(words: DataFrame) -> DataFrame:
    """key and id of all keys of words (id, word)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "word"):
                which, key = deletion_keys(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id").slice(lo, hi - lo).take(pa.array(which))], names=["key", "id"])

    return words.select("id", "word").mapInArrow(scan, "key long, id long")


def near(words: DataFrame) -> DataFrame:
    """a, b with a < b: the ids of each two words (id, word) whose edit distance is 1; ids are distinct, and words are."""
    keys = written(keyed(words), "keys")
    # a key that only one word has meets nothing
    met = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    shared = written(keys.join(met, "key"), "shared")
    a, b = (shared.select("key", F.col("id").alias(c)) for c in "ab")
    pairs = written(a.join(b, "key").where("a < b").select("a", "b").distinct(), "pairs")
    texts = [words.select(F.col("id").alias(c), F.col("word").alias(f"w{c}")) for c in "ab"]
    links = written(pairs.join(texts[0], "a").join(texts[1], "b").where(F.levenshtein("wa", "wb", 1) == 1).select("a", "b"), "near")
    delete(keys, shared, pairs)
    return links


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words (word, form): the last of the forms that follow each other from there; they make no circle."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        delete(at)
        at = further.select("word", "root")
        if not further.agg(F.max("moved")).first()[0]:
            return at


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    Two words are near if one inserted, deleted or replaced character makes one into the other; n_near is how many
    near words a word has.  Its form is the near word of the largest n, of several the first in the order of
    characters, if that n, form_n, is `times` as large as the word's at least; else both are null.  root is
    the end of the forms from the word on, itself if it has none.  Rows without a word are left out.
    """
    words = written(counts.where("word is not null").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    links = near(words)
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p")).select("p.*")
    others = words.select(F.col("id").alias("other"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")).alias("best"))
    best = both.join(others, "other").groupBy("id").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    form_n = -F.col("best.less")
    found = words.join(best, "id", "left").withColumn("form_n", F.when(form_n >= F.col("n") * times, form_n))
    found = written(found.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "forms")
    last = roots(found.where("form is not null"))
    delete(words, links)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
