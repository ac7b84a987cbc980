"""Words of Arrow string columns as arrays, for use inside tasks.

A batch is walked in slices of a bounded number of bytes, so that a worker's memory does not depend on
how many rows Spark puts into a batch.  A text that is longer than the bound makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]+`, of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the ordered pair of two hashes."""
    with np.errstate(over="ignore"):
        return mix(a * _M1 + (b ^ (b >> np.uint64(29))) + np.uint64(0x632BE59BD9B4E019))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); null texts are empty."""
    col = batch.column(column)
    col = col.fill_null("") if col.null_count else col
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray = ALNUM, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, first word of each row) of all words; the last array has one entry more than there are rows.

    A word is a longest run of kept bytes within a row.  Its hash is a function of all its bytes.
    """
    n = len(data)
    buf = np.zeros(n + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=buf[:n]) if lower else np.copyto(buf[:n], data)
    inside = np.zeros(n + 2, dtype=bool)
    np.take(kept, buf[:n], out=inside[1:-1])
    starting = inside[1:-1] & ~inside[:-2]
    ending = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]  # a word does not run from one row into the next
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starting[cuts] = inside[1:-1][cuts]
    ending[cuts - 1] = inside[1:-1][cuts - 1]
    start, size = np.flatnonzero(starting), np.flatnonzero(ending) + 1
    first = np.searchsorted(start, offsets)
    size -= start
    eight = np.ndarray((n + 1,), dtype="<u8", buffer=buf, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = mix((eight[start] & masks[np.minimum(size, 8)]) + size.astype(np.uint64) * _M1)
        left, at = np.flatnonzero(size > 8), 8
        while len(left):
            out[left] = combine(out[left], eight[start[left] + at] & masks[np.minimum(size[left] - at, 8)])
            at += 8
            left = left[size[left] > at]
    return out, start, first


def hash_word(word: bytes) -> int:
    """The hash that words() gives a single word."""
    return int(words(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]), np.ones(256, dtype=bool), lower=False)[0][0])
