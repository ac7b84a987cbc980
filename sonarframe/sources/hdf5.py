"""HDF5 recordings without a library for it: datasets as rows, read by many tasks.

A first pass has a task for each file walk the groups and, of each dataset that is asked for, the index of its
chunks; its rows say where which rows of the data are.  These pieces are dealt out, and each task reads the bytes of
its pieces alone.  So a file may have any size, and no task holds more than a piece.  Files are opened by Arrow's
file systems, which know local and shared folders and the usual object stores.

Read are files as the format's library writes them unless asked for its newest features: old-style groups, contiguous,
compact and chunked layouts with the deflate, shuffle and checksum filters, integers, floating-point numbers and strings.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: signature, message types, filters, the address of nothing.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, DATATYPE, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = (1 << 64) - 1

#: Bytes of a piece of data that has no chunks of its own.
PIECE = 4 << 20

_PIECE = "path string, name string, first bigint, n bigint, columns int, kind string, filters array<int>, parts array<struct<column:int,width:int,rows:int,mask:int,at:bigint,size:bigint>>"


class File:
    """Reads of numbers and ranges of an open file."""

    def __init__(self, source):
        self.source = source
        start = self.bytes(0, 64)
        if start[:8] != SIGNATURE:
            raise ValueError("this is not an HDF5 file")
        if start[8] > 1 or start[13:15] != b"\x08\x08":
            raise ValueError("only files of the format's first version, with addresses of 8 bytes, are read")
        at = 24 + 4 * start[8]
        (self.base,) = struct.unpack_from("<Q", start, at)
        (self.root,) = self.numbers(at + 40, "<Q")

    def bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        out = self.source.read(size)
        if len(out) < size:
            raise ValueError("the file is cut off")
        return out

    def numbers(self, at: int, layout: str) -> tuple:
        return struct.unpack(layout, self.bytes(at, struct.calcsize(layout)))

    def messages(self, at: int) -> dict[int, tuple[bytes, int]]:
        """(content, where it is) of the messages of an object's header, by type."""
        version, _, _, _, size = self.numbers(self.base + at, "<BBHII")
        if version != 1:
            raise ValueError("only object headers of the first version are read")
        out: dict[int, tuple[bytes, int]] = {}
        blocks = [(self.base + at + 16, size)]
        for begin, size in blocks:  # grows as it is walked
            data, k = self.bytes(begin, size), 0
            while k + 8 <= len(data):
                kind, n = struct.unpack_from("<HH", data, k)
                body, where_, k = data[k + 8 : k + 8 + n], begin + k + 8, k + 8 + n
                if kind == CONTINUED:
                    where, length = struct.unpack("<QQ", body[:16])
                    blocks.append((self.base + where, length))
                else:
                    out.setdefault(kind, (body, where_))
        return out

    def members(self, at: int) -> dict[str, int]:
        """Where the objects of a group are, by name."""
        tree, heap = struct.unpack("<QQ", self.messages(at)[SYMBOLS][0][:16])
        sign, _, _, where = self.numbers(self.base + heap, "<4s4xQQQ")
        if sign != b"HEAP":
            raise ValueError("a group without names")
        out: dict[str, int] = {}
        for node in self.leaves(tree, 0):
            (n,) = self.numbers(self.base + node + 6, "<H")
            for k in range(n):
                name, header = self.numbers(self.base + node + 8 + 40 * k, "<QQ")
                text = b""
                while b"\0" not in text:
                    self.source.seek(self.base + where + name + len(text))
                    more = self.source.read(64)
                    text += more or b"\0"
                out[text.split(b"\0")[0].decode()] = header
        return out

    def leaves(self, tree: int, rank: int) -> Iterator[int | tuple]:
        """What a tree refers to: addresses of a group's symbols (rank 0), or (size, mask, offsets, address) of the chunks of a dataset."""
        key = 8 if not rank else 8 + 8 * (rank + 1)
        sign, kind, level, n = self.numbers(self.base + tree, "<4sBBH")
        if sign != b"TREE" or kind != (rank > 0):
            raise ValueError("a tree of another kind")
        data = self.bytes(self.base + tree + 24, n * (key + 8))
        for k in range(n):
            head = data[k * (key + 8) : (k + 1) * (key + 8)]
            (child,) = struct.unpack_from("<Q", head, key)
            if level:
                yield from self.leaves(child, rank)
            elif rank:
                yield (*struct.unpack_from("<II", head), struct.unpack_from(f"<{rank}Q", head, 8), child)
            else:
                yield child


def _kind(body: bytes) -> str:
    """A datatype as numpy names it, or "vlen" for strings of any length."""
    family, flags = body[0] & 15, body[1]
    (size,) = struct.unpack_from("<I", body, 4)
    order = ">" if flags & 1 else "<"
    if family == 0:
        return f"{order}{'i' if flags & 8 else 'u'}{size}"
    if family == 1:
        return f"{order}f{size}"
    if family == 3:
        return f"S{size}"
    if family == 9 and flags & 15 == 1:
        return "vlen"
    raise ValueError(f"data of class {family} are not read")


def _filters(body: bytes | None) -> list[int]:
    """The numbers of the filters, in the order in which they were applied."""
    if body is None:
        return []
    out, at = [], 8 if body[0] == 1 else 2
    for _ in range(body[1]):
        (number,) = struct.unpack_from("<H", body, at)
        named = body[0] == 1 or number >= 256
        length = struct.unpack_from("<H", body, at + 2)[0] if named else 0
        _, values = struct.unpack_from("<HH", body, at + (4 if named else 2))
        at += (8 if named else 6) + (length + 7) // 8 * 8 * (body[0] == 1) + length * (body[0] != 1) + 4 * values + 4 * (values % 2) * (body[0] == 1)
        out.append(number)
    return out


def pieces(file: File, name: str, at: int) -> Iterator[tuple]:
    """(name, first row, rows, columns, kind, filters, parts) of the pieces of a dataset; parts of a piece are chunks side by side."""
    m = file.messages(at)
    space, kind, filters = m[DATASPACE][0], _kind(m[DATATYPE][0]), _filters(m.get(FILTERS, (None, 0))[0])
    layout, place = m[LAYOUT]
    if unknown := set(filters) - {DEFLATE, SHUFFLE, CHECKSUM}:
        raise ValueError(f"{name} has filters that are not read: {sorted(unknown)}")
    rank = space[1]
    shape = struct.unpack_from(f"<{rank}Q", space, 8 if space[0] == 1 else 4)
    rows, columns = (shape[0] if rank else 1), int(np.prod(shape[1:], dtype=np.int64))
    width = 16 if kind == "vlen" else np.dtype(kind).itemsize
    if layout[0] != 3 or rank > 2:
        raise ValueError(f"{name} has a layout that is not read")
    if layout[1] < 2:
        if layout[1] == 0:
            begin = place + 4  # in the header itself
        else:
            begin = struct.unpack_from("<Q", layout, 2)[0]
            begin = None if begin == NOWHERE else file.base + begin
        step = max(1, PIECE // max(1, columns * width))
        for lo in range(0, rows if begin is not None else 0, step):
            n = min(step, rows - lo)
            yield name, lo, n, columns, kind, [], [(0, columns, n, 0, begin + lo * columns * width, n * columns * width)]
        return
    n_dims = layout[2]
    (tree,) = struct.unpack_from("<Q", layout, 3)
    chunk = struct.unpack_from(f"<{n_dims}I", layout, 11)[: n_dims - 1]
    held: list[tuple] = []
    across = chunk[1] if rank == 2 else 1
    for size, mask, offset, where in file.leaves(tree, rank) if tree != NOWHERE else ():  # in the order of their offsets
        if held and held[0][0] != offset[0]:
            yield _piece(name, held, rows, columns, kind, filters, chunk[0])
            held = []
        held.append((offset[0], (offset[1] if rank == 2 else 0, across, chunk[0], mask, file.base + where, size)))
    if held:
        yield _piece(name, held, rows, columns, kind, filters, chunk[0])


def _piece(name: str, held: list[tuple], rows: int, columns: int, kind: str, filters: list[int], high: int) -> tuple:
    return name, held[0][0], min(high, rows - held[0][0]), columns, kind, filters, [part for _, part in held]


def unfiltered(raw: bytes, filters: Sequence[int], mask: int, width: int) -> bytes:
    """The bytes of a chunk before its filters, of which those that the mask names were left out."""
    for k in reversed(range(len(filters))):
        if mask >> k & 1:
            continue
        if filters[k] == CHECKSUM:
            raw = raw[:-4]
        elif filters[k] == DEFLATE:
            raw = zlib.decompress(raw)
        else:
            n = len(raw) // width
            raw = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T.tobytes() + raw[n * width :]
    return raw


def _opened(path: str):
    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _texts(source, base: int, raw: bytes) -> list[str]:
    """Strings of any length by where the file keeps them."""
    out = []
    for length, heap, number in struct.iter_unpack("<IQI", raw):
        text = b""
        if length:
            source.seek(base + heap)
            sign, size = struct.unpack("<4s4xQ", source.read(16))
            if sign != b"GCOL":
                raise ValueError("a string without its heap")
            data, at = source.read(size - 16), 0
            while at + 16 <= len(data):
                index, n = struct.unpack_from("<H6xQ", data, at)
                if index == number:
                    text = data[at + 16 : at + 16 + length]
                    break
                at += 16 + (n + 7) // 8 * 8
        out.append(text.split(b"\0")[0].decode("utf-8", "replace"))
    return out


def read(spark: SparkSession, path: str, names: Sequence[str], per_task: int = 8) -> DataFrame:
    """path, name, idx, x, texts: the rows of the datasets of these names in the root groups of files; x has numbers, texts strings.

    A dataset of one dimension has rows of one element, and a single value is a row.  Of more than two dimensions none are
    read.  Datasets that a file does not have give no rows, and chunks that were never written no rows either.
    """
    asked = list(names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.strip().split(" ")[0] for c in ("path", "name", "first", "n", "columns", "kind", "filters", "parts")]
        part = pa.struct([("column", pa.int32()), ("width", pa.int32()), ("rows", pa.int32()), ("mask", pa.int32()), ("at", pa.int64()), ("size", pa.int64())])
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(part)]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=columns)

        for batch in batches:
            for p in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with _opened(p) as source:
                    file = File(source)
                    found = file.members(file.root)
                    for name in asked:
                        for piece in pieces(file, name, found[name]) if name in found else ():
                            rows.append((p, *piece[:-1], [dict(zip([f.name for f in part], x, strict=True)) for x in piece[-1]]))
                            if len(rows) == 4096:
                                yield packed(rows)
                                rows = []
                if rows:
                    yield packed(rows)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as source:
                    yield _loaded(source, row)

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    found = files.mapInArrow(index, _PIECE)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per_task
    return found.repartition(tasks, "path", "name", "first").mapInArrow(load, "path string, name string, idx bigint, x array<double>, texts array<string>")


def _loaded(source, row: dict) -> pa.RecordBatch:
    n, columns, kind = row["n"], row["columns"], row["kind"]
    width = 16 if kind == "vlen" else np.dtype(kind).itemsize
    out = np.zeros((n, columns), dtype=np.dtype("V16" if kind == "vlen" else kind))
    for part in row["parts"]:
        source.seek(part["at"])
        raw = unfiltered(source.read(part["size"]), row["filters"], part["mask"], width)
        across = min(part["width"], columns - part["column"])
        out[:, part["column"] : part["column"] + across] = np.frombuffer(raw, out.dtype, part["rows"] * part["width"]).reshape(part["rows"], part["width"])[:n, :across]
    ends = pa.array(np.arange(n + 1) * columns, pa.int32())
    x = texts = None
    if kind == "vlen":
        texts = _texts(source, File(source).base, out.tobytes())
    elif kind[0] == "S":
        texts = [v.split(b"\0")[0].decode("utf-8", "replace") for v in out.ravel().tolist()]
    else:
        x = pa.ListArray.from_arrays(ends, pa.array(out.ravel().astype(np.float64)))
    x = pa.nulls(n, pa.list_(pa.float64())) if x is None else x
    t = pa.nulls(n, pa.list_(pa.string())) if texts is None else pa.ListArray.from_arrays(ends, pa.array(texts, pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([row["path"]] * n), pa.array([row["name"]] * n), pa.array(np.arange(row["first"], row["first"] + n)), x, t], names=["path", "name", "idx", "x", "texts"])
