"""Sorted Arrow batches as whole groups, for kernels that work on many groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of neighbouring rows that are alike in keys begin."""
    new = np.arange(len(table)) == 0
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts of its groups) of about so many rows each; no group is cut, whatever its size."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, rows
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= enough:
            table = pa.Table.from_batches(held)
            at = starts(table, keys)
            if len(at) > 1:
                yield table.slice(0, at[-1]).combine_chunks(), at[:-1]
                table = table.slice(at[-1])
            held, n = table.to_batches(), len(table)
            enough = max(rows, 2 * n)
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table, keys)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """A numeric column as doubles, nulls as NaN."""
    return np.asarray(table[column].to_numpy(), dtype=float)
