"""XDF containers: chunks of stream headers, samples, clock offsets and footers, by the public description of the format.

A recorder writes a boundary chunk every few seconds, which ends in a fixed signature.  Spark's text reader splits
files at any separator, so with the signature as the separator its rows are the segments between boundaries: a file
of any size is read by many tasks, from any store that Spark knows, and what is broken is skipped to the next
boundary.  A row has a whole segment, so files that have no boundaries, or are compressed, are one task's work.

What a segment needs of the ones before it, the number of its first sample and the last stamp, is carried: a pass over
the stamps counts each segment's samples, and running sums along a stream's segments say where each begins.  Only
the streams, kinds and channels that are asked for are decoded; other chunks are stepped over by their length.
"""

from __future__ import annotations

import gzip
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import sized, staged

# Fixed values of the format: its magic, its sample formats and the signature of boundary chunks.
MAGIC = b"XDF:"
FORMATS = {"double64": "d", "float32": "f", "int64": "q", "int32": "i", "int16": "h", "int8": "b"}
BOUNDARY = bytes([0x43, 0xA5, 0x46, 0xDC, 0xCB, 0xF5, 0x41, 0x0F, 0xB3, 0x0E, 0xD5, 0x46, 0x73, 0x83, 0xCB, 0xE4])

SCHEMA = "path string, stream bigint, kind string, idx bigint, stamp double, offset double, x array<double>, texts array<string>, xml string"
#: What a chunk's tag says it is; other tags carry no rows.
KINDS = {2: "header", 3: "sample", 4: "clock", 6: "footer"}
BATCH = 20_000

_LOCAL = pa.schema([("path", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("stream", pa.int64()), ("kind", pa.string()), ("idx", pa.int64()), ("stamp", pa.float64()), ("since", pa.int64()), ("offset", pa.float64()), ("x", pa.list_(pa.float64())), ("texts", pa.list_(pa.string())), ("xml", pa.string())])
_LOCAL_DDL = "path string, block bigint, number bigint, stream bigint, kind string, idx bigint, stamp double, since bigint, offset double, x array<double>, texts array<string>, xml string"


def varlen(data: memoryview, at: int) -> tuple[int, int]:
    """(number, position behind it) of a number with its size in front: 1, 4 or 8 bytes."""
    size = data[at]
    if size not in (1, 4, 8):
        raise ValueError("no length here")
    return int.from_bytes(data[at + 1 : at + 1 + size], "little"), at + 1 + size


def chunks(segment: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(tag, content) of each chunk up to the first that is broken, or cut off as the boundary chunk at the segment's end is."""
    at = 0
    while at < len(segment):
        try:
            length, begin = varlen(segment, at)
        except (ValueError, IndexError):
            return
        tag = int.from_bytes(segment[begin : begin + 2], "little")
        if length < 2 or begin + length > len(segment) or not 1 <= tag <= 6:
            return
        yield tag, segment[begin + 2 : begin + length]
        at = begin + length


def as_dict(node: ET.Element) -> dict | str | None:
    """Nested elements: the text of a leaf, else children by name, of repeated ones a list."""
    if not len(node):
        return node.text
    out: dict = {}
    for child in node:
        value = as_dict(child)
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
        else:
            out[child.tag] = value
    return out


def layout(content: memoryview, fmt: str, channels: int) -> tuple[np.ndarray, np.ndarray]:
    """(stamps, NaN where there is none; where each sample's values begin) of a chunk of samples; what is cut off raises.

    Nearly all chunks have a stamp at their first sample, at each or at none, which is tried before a walk from sample to sample.
    """
    if fmt != "string" and fmt not in FORMATS:
        raise ValueError("samples of an unknown format")
    n, at = varlen(content, 0)
    raw = np.frombuffer(content, dtype=np.uint8)
    size = 0 if fmt == "string" else channels * np.dtype(FORMATS[fmt]).itemsize
    for first, later in ((8, 0), (8, 8), (0, 0)) if fmt != "string" and n else ():
        flags = at + np.arange(n + 1) * (1 + later + size)
        flags[1:] += first - later
        if flags[-1] <= len(raw) and (raw[flags[0]] > 0) == (first > 0) and ((raw[flags[1:-1]] > 0) == (later > 0)).all():
            stamped = np.arange(n) < (n if later else min(1, first))
            break
    else:
        flags, stamped = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
        for k in range(n):
            flags[k], stamped[k] = at, content[at] > 0
            at += 1 + 8 * int(stamped[k]) + size
            for _ in range(channels if fmt == "string" else 0):
                length, at = varlen(content, at)
                at += length
        if at > len(raw):
            raise ValueError("a sample is cut off")
    stamps = np.full(n, np.nan)
    stamps[stamped] = raw[(flags[:n][stamped] + 1)[:, None] + np.arange(8)].view("<f8")[:, 0] if stamped.any() else 0
    return stamps, flags[:n] + 1 + 8 * stamped


def numeric(content: memoryview, begins: np.ndarray, fmt: str, channels: int) -> np.ndarray:
    """Samples x channels as doubles."""
    kind = np.dtype("<" + FORMATS[fmt])
    steps = np.diff(begins[1:])
    if len(begins) > 2 and (steps == steps[0]).all():
        rest = np.ndarray((len(begins) - 1, channels), dtype=kind, buffer=content, offset=int(begins[1]), strides=(int(steps[0]), kind.itemsize))
        return np.concatenate([np.frombuffer(content, kind, channels, int(begins[0]))[None], rest]).astype(np.float64)
    return np.array([np.frombuffer(content, kind, channels, int(b)) for b in begins], dtype=np.float64).reshape(len(begins), channels)


def strings(content: memoryview, begins: np.ndarray, channels: int) -> list[list[str]]:
    out = []
    for at in begins.tolist():
        values = []
        for _ in range(channels):
            n, at = varlen(content, at)
            values.append(bytes(content[at : at + n]).decode("utf-8", "replace"))
            at += n
        out.append(values)
    return out


def segments(spark: SparkSession, path: str, files: str = "*.xdf", compressed: str = "*.{xdfz,xdf.gz}") -> DataFrame:
    """path, block (where the file's split begins) and data of each segment; the segments of a block follow each other in one task."""
    source = F.col("_metadata.file_path").alias("path")
    read = spark.read.format("text").options(lineSep=BOUNDARY.decode("latin-1"), encoding="ISO-8859-1", pathGlobFilter=files).load(path)
    plain = read.select(source, F.col("_metadata.file_block_start").cast("bigint").alias("block"), F.col("value").cast("binary").alias("data"))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in gzip.decompress(content).split(BOUNDARY):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([0]), pa.array([part], pa.binary())], names=["path", "block", "data"])

    packed = spark.read.format("binaryFile").option("pathGlobFilter", compressed).load(path)
    return plain.unionByName(packed.select(source, "content").mapInArrow(unpacked, "path string, block bigint, data binary"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, memoryview, dict[int, tuple[str, int]]]]:
    """(path, block, number in the block, content, formats and channels of the wanted streams) of each segment."""
    last, k = None, 0
    for batch in batches:
        wanted = batch.column("wanted").to_pylist() if "wanted" in batch.schema.names else [[]] * batch.num_rows
        for p, block, data, own in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), batch.column("data"), wanted, strict=True):
            k = k + 1 if (p, block) == last else 0
            last = (p, block)
            content = memoryview(data.as_buffer())
            if not (block or k):
                if content[:4] != MAGIC:
                    raise ValueError(f"{p} is not an XDF file")
                content = content[4:]
            yield p, block, k, content, {s["stream"]: (s["format"], s["channels"]) for s in own}


def headers(parts: DataFrame) -> DataFrame:
    """path, stream, xml and the format, channels, srate, name and type that it has, for each stream of segments(); of repeated headers the last counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, block, number, content, _ in _numbered(batches):
            for tag, data in chunks(content):
                if tag == 2 and len(data) >= 4:
                    row = (p, block, number, int.from_bytes(data[:4], "little"), bytes(data[4:]).decode("utf-8", "replace"))
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["path", "block", "number", "stream", "xml"])

    found = parts.mapInArrow(scan, "path string, block bigint, number bigint, stream bigint, xml string")
    found = found.groupBy("path", "stream").agg(F.max_by("xml", F.struct("block", "number")).alias("xml"))
    return _described(found)


def _described(found: DataFrame) -> DataFrame:
    get = lambda tag: F.nullif(F.xpath_string("xml", F.lit(f"/info/{tag}")), F.lit(""))
    return found.withColumns({"name": get("name"), "type": get("type"), "channels": get("channel_count").cast("int"), "srate": get("nominal_srate").cast("double"), "format": get("channel_format")})


def _states(parts: DataFrame) -> DataFrame:
    """path, block, number, stream, n, stamp, since: of each segment's streams the samples, the last stamp and how many samples have followed it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, block, number, content, wanted in _numbered(batches):
            states: dict[int, list] = {}
            for tag, data in chunks(content):
                stream = int.from_bytes(data[:4], "little")
                if tag == 3 and stream in wanted:
                    try:
                        stamps, _ = layout(data[4:], *wanted[stream])
                    except (ValueError, IndexError, struct.error):
                        continue
                    state = states.setdefault(stream, [0, None, 0])
                    at = np.flatnonzero(~np.isnan(stamps))
                    state[0] += len(stamps)
                    state[1:] = [float(stamps[at[-1]]), len(stamps) - 1 - int(at[-1])] if len(at) else [state[1], state[2] + len(stamps)]
            if states:
                n = len(states)
                columns = [[p] * n, [block] * n, [number] * n, list(states), *map(list, zip(*states.values(), strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 4, pa.float64(), pa.int64()], strict=True)], names=["path", "block", "number", "stream", "n", "stamp", "since"])

    return parts.mapInArrow(scan, "path string, block bigint, number bigint, stream bigint, n bigint, stamp double, since bigint")


def carried(states: DataFrame) -> DataFrame:
    """path, block, number, stream, before, last_stamp, last_at: samples before the segment, the last stamp before it (0) and the count of samples up to that stamp's (0).

    A stream has a row for each segment of its file, so running along them is a window over some thousands of rows.
    """
    w = Window.partitionBy("path", "stream").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, -1)
    found = states.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    stamped = F.when(F.col("stamp").isNotNull(), F.struct("stamp", (F.col("before") + F.col("n") - F.col("since")).alias("at")))
    found = found.withColumn("own", stamped).withColumn("last", F.last("own", ignorenulls=True).over(w))
    return found.select("path", "block", "number", "stream", "before", F.coalesce("last.stamp", F.lit(0.0)).alias("last_stamp"), F.coalesce("last.at", F.lit(0)).alias("last_at"))


def _decoded(parts: DataFrame, kinds: Sequence[str], channels: Sequence[int] | None, counter: Accumulator | None) -> DataFrame:
    """Rows of the wanted streams of segments: idx from 0 in the segment; stamp is the last in it up to the sample, since how many samples ago that was, null without one."""

    def made(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array([columns.get(f.name)] * n, f.type) for f in _LOCAL], schema=_LOCAL)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, block, number, content, wanted in _numbered(batches):
            states: dict[int, tuple[int, float, int]] = {}  # samples, last stamp, samples since
            for tag, data in chunks(content):
                stream, kind, body = int.from_bytes(data[:4], "little"), KINDS.get(tag), data[4:]
                if kind not in kinds or stream not in wanted:
                    continue
                known = {"path": p, "block": block, "number": number, "stream": stream, "kind": kind}
                if kind in ("header", "footer"):
                    yield made(1, **known, xml=bytes(body).decode("utf-8", "replace"))
                elif kind == "clock" and len(body) >= 16:
                    t, offset = struct.unpack_from("<dd", body)
                    yield made(1, **known, stamp=t, offset=offset)
                elif kind == "sample":
                    fmt, width = wanted[stream]
                    try:
                        stamps, begins = layout(body, fmt, width)
                        values = strings(body, begins, width) if fmt == "string" else numeric(body, begins, fmt, width)
                    except (ValueError, IndexError, struct.error):
                        continue
                    if counter is not None:
                        counter.add(1)
                    n = len(stamps)
                    first, stamp, since = states.get(stream, (0, np.nan, 0))
                    at = np.maximum.accumulate(np.where(np.isnan(stamps), -1, np.arange(n))) if n else np.zeros(0, np.int64)
                    anchor = np.where(at >= 0, stamps[at], stamp)
                    ago = np.where(at >= 0, np.arange(n) - at, since + 1 + np.arange(n))
                    if n:
                        states[stream] = (first + n, anchor[-1], int(ago[-1]))
                    own = {"idx": pa.array(np.arange(first, first + n)), "stamp": pa.array(anchor, from_pandas=True), "since": pa.array(ago)}
                    if fmt == "string":
                        own["texts"] = pa.array(values, pa.list_(pa.string()))
                    else:
                        values = values if channels is None else values[:, list(channels)]
                        own["x"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
                    yield made(n, **known, **own)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in rows(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        yield from pa.Table.from_batches(held, _LOCAL).combine_chunks().to_batches()

    return parts.mapInArrow(joined, _LOCAL_DDL)


def read(spark: SparkSession, path: str, names: Sequence[str] | None = None, types: Sequence[str] | None = None, kinds: Sequence[str] = ("header", "sample", "clock", "footer"), channels: Sequence[int] | None = None, files: str = "*.xdf", counter: Accumulator | None = None) -> DataFrame:
    """Rows of SCHEMA from .xdf, .xdfz and .xdf.gz files: headers, samples, clock measurements and footers.

    names and types choose streams that have one of them; without either, all are read.  kinds chooses rows and
    channels the positions that numeric samples keep; what is not chosen is not decoded.  counter counts the
    chunks of samples that are.  Samples are numbered within their stream.  A stamp that is missing is the last one
    before it plus the time of the samples since; before the first stamp that is 0.  A chunk of samples that is broken is
    skipped, as are streams without a header, or of an unknown format.  Files that are no containers are an error.
    """
    parts = segments(spark, path, files)
    known = staged(headers(parts), "xdf-headers")
    chosen = None
    for column, values in (("name", names), ("type", types)):
        if values is not None:
            hit = F.col(column).isin(list(values))
            chosen = hit if chosen is None else chosen | hit
    known = known if chosen is None else known.where(chosen)
    readable = F.col("format").isin("string", *FORMATS) & (F.coalesce("channels", F.lit(0)) > 0)
    own = known.groupBy("path").agg(F.collect_list(F.struct("stream", F.when(readable, F.col("format")).alias("format"), "channels")).alias("wanted"))
    rows = parts.join(sized(own), "path").select("path", "block", "data", "wanted")
    out = _decoded(rows, kinds, channels, counter)
    if "sample" not in kinds:
        return out.select(*(c.split()[0] for c in SCHEMA.split(", ")))
    begin = sized(staged(carried(_states(rows)), "xdf-states"))
    rate = known.select("path", "stream", F.when(F.col("srate") > 0, 1 / F.col("srate")).otherwise(0.0).alias("dt"))
    out = out.join(begin, ["path", "block", "number", "stream"], "left").join(sized(rate), ["path", "stream"], "left")
    idx = F.col("before") + F.col("idx")
    filled = F.when(F.col("stamp").isNotNull(), F.col("stamp") + F.col("since") * F.col("dt")).otherwise(F.col("last_stamp") + (idx + 1 - F.col("last_at")) * F.col("dt"))
    sample = F.col("kind") == "sample"
    return out.select("path", "stream", "kind", F.when(sample, idx).alias("idx"), F.when(sample, filled).otherwise(F.col("stamp")).alias("stamp"), "offset", "x", "texts", "xml")


def streams(rows: DataFrame) -> DataFrame:
    """path, stream, name, type, channels, srate, format of each header."""
    return _described(rows.where("kind = 'header'").select("path", "stream", "xml")).drop("xml")


def labels(rows: DataFrame) -> DataFrame:
    """path, stream, ch and name of the channels that a header names."""
    found = F.xpath("xml", F.lit("/info/desc/channels/channel/label/text()"))
    return rows.where("kind = 'header'").select("path", "stream", F.posexplode(found).alias("ch", "name"))


def signals(rows: DataFrame) -> DataFrame:
    """path, stream, idx, t, x of the numeric samples."""
    return rows.where("kind = 'sample' and x is not null").select("path", "stream", "idx", F.col("stamp").alias("t"), "x")


def markers(rows: DataFrame) -> DataFrame:
    """path, stream, idx, t, label of the samples that are text."""
    return rows.where("kind = 'sample' and texts is not null").select("path", "stream", "idx", F.col("stamp").alias("t"), F.get("texts", F.lit(0)).alias("label"))


def clock(rows: DataFrame) -> DataFrame:
    """path, stream, seq, t, offset of the clock measurements, numbered by their time of arrival."""
    found = rows.where("kind = 'clock'").select("path", "stream", F.monotonically_increasing_id().alias("_at"), F.col("stamp").alias("t"), "offset")
    return found.withColumn("seq", F.row_number().over(Window.partitionBy("path", "stream").orderBy("_at"))).drop("_at")


def synchronised(rows: DataFrame, synchronise: bool = True, dejitter: bool = True, gap: float = 1.0, samples: float = 500.0) -> DataFrame:
    """Rows of read() with the samples' stamps in the recording computer's clock and, for streams with a rate, on straight lines.

    Clock measurements correct each stream's stamps; then stamps between gaps of more than `gap` seconds and
    `samples` samples are put on their least-squares line, which takes the jitter out.  Streams without
    measurements, or without a rate, keep their stamps in that step.
    """
    from ..operators import clock as clocks
    from ..operators import frames

    key = F.concat_ws("#", F.col("path"), F.col("stream").cast("string"))
    stamps = rows.where("kind = 'sample'").select(key.alias("key"), "idx", F.col("stamp").alias("t"))
    if synchronise:
        stamps = clocks.synchronised(stamps, clock(rows).select(key.alias("key"), "seq", "t", "offset"), "key")
    if dejitter:
        rated = streams(rows).where("srate > 0").select(key.alias("key"), F.greatest(F.lit(gap), F.lit(samples) / F.col("srate")).alias("most"))
        own = stamps.join(rated, "key").withColumn("scaled", F.col("t") / F.col("most"))  # a gap is more than 1 of these
        smooth = frames.dejittered(own, 1.0, "key", "scaled").select("key", "idx", (F.col("smooth") * F.col("most")).alias("t"))
        stamps = stamps.join(rated.select("key"), "key", "left_anti").unionByName(smooth)
    found = rows.where("kind = 'sample'").withColumn("key", key).join(stamps.select("key", "idx", "t"), ["key", "idx"])
    found = found.withColumn("stamp", F.col("t")).select(*rows.columns)
    return found.unionByName(rows.where("kind <> 'sample'"))


def load(spark: SparkSession, path: str, synchronise: bool = True, dejitter: bool = True, **chosen) -> DataFrame:
    """read() and synchronised(): how recordings are loaded unless one asks for the stored stamps; chosen: what read() takes."""
    return synchronised(staged(read(spark, path, **chosen), "xdf-rows"), synchronise, dejitter)


def named(rows: DataFrame, name: str) -> DataFrame:
    """path, idx, t, x of the numeric samples of the stream of that name."""
    own = streams(rows).where(F.col("name") == name).select("path", "stream")
    return signals(rows).join(own, ["path", "stream"]).drop("stream")


def experiment(rows: DataFrame, kinds: dict[str, str] | None = None, start: str = "experimentStarted", end: str = "experimentEnded") -> DataFrame:
    """path, kind, idx, t, x of the recorded streams between the markers; idx begins at 0.

    kinds names each kind's stream, the leading one first.  Its ends are its samples nearest to the markers; those of the
    others are the samples nearest to the leading stream's ends.  The last sample is left out.  Files without a
    start have no rows; without a later end they run to their last sample.
    """
    from ..operators.joins import nearest

    kinds = kinds or STREAMS
    m = markers(rows)
    first = m.where(F.col("label") == start).groupBy("path").agg(F.min("t").alias("s"))
    last = m.where(F.col("label") == end).join(first, "path").where("t > s").groupBy("path").agg(F.min("t").alias("e"))
    bounds = first.join(last, "path", "left")
    out = None
    for kind, name in kinds.items():
        own = named(rows, name)
        points = bounds.select("path", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("t")) for c in "se"))).alias("p")).select("path", "p.*").where("t is not null")
        at = nearest(points, own.select("path", "t", F.struct("idx", "t").alias("hit")), "path", "t", "hit").groupBy("path")
        at = at.agg(*(F.max(F.when(F.col("side") == c, F.col("hit"))).alias(f"_{c}") for c in "se"))
        cut = own.join(at, "path").where((F.col("idx") >= F.col("_s.idx")) & (F.col("_e").isNull() | (F.col("idx") < F.col("_e.idx"))))
        cut = cut.select("path", F.lit(kind).alias("kind"), (F.col("idx") - F.col("_s.idx")).alias("idx"), "t", "x")
        if out is None:
            out, bounds = cut, at.select("path", F.col("_s.t").alias("s"), F.col("_e.t").alias("e"))
        else:
            out = out.unionByName(cut)
    return out


def experiment_markers(rows: DataFrame, end: str = "experimentEnded") -> DataFrame:
    """path, idx, t, label of the markers before the end."""
    m = markers(rows)
    last = m.where(F.col("label") == end).groupBy("path").agg(F.min("idx").alias("_last"))
    return m.join(last, "path", "left").where(F.col("_last").isNull() | (F.col("idx") < F.col("_last"))).select("path", "idx", "t", "label")


#: The streams of a recording of speech, the leading one first.
STREAMS = {"sEEG": "Micromed", "Audio": "AudioCaptureWin"}


def recording(spark: SparkSession, path: str, kinds: dict[str, str] | None = None, markers: Sequence[str] = ("Markers",), **options) -> tuple[DataFrame, DataFrame]:
    """(experiment(), experiment_markers()) of load(), of which only the kinds' streams and those of markers are read."""
    kinds = kinds or STREAMS
    rows = staged(load(spark, path, names=list(kinds.values()), types=markers, **options), "xdf-recording")
    return experiment(rows, kinds), experiment_markers(rows)


def neural(spark: SparkSession, path: str, name: str = "Micromed", **options) -> DataFrame:
    """path, idx, t, x of the neural stream between the markers, for recordings of other tasks: sound is not read."""
    return recording(spark, path, {"sEEG": name}, **options)[0].drop("kind")


def packed(samples: DataFrame, heads: DataFrame, per: int = 512) -> DataFrame:
    """recording, at and value: the segments of containers, in their order, of samples (recording, stream, idx, t, x) and heads (recording, stream, xml).

    A chunk has `per` samples of a stream at most; a sample whose t is null has no stamp.  Numbers are doubles.  A segment
    is what `per` consecutive numbers of all of a recording's streams make, and the headers are the first.
    """

    def length(n: int) -> bytes:
        return bytes([4]) + struct.pack("<I", n)

    def chunk(tag: int, stream: int, body: bytes) -> bytes:
        return length(len(body) + 6) + struct.pack("<HI", tag, stream) + body

    kind = samples.schema["recording"].dataType.simpleString()
    end = bytes([1, 18]) + struct.pack("<H", 5)  # of a boundary chunk, whose signature is the separator

    def pack(table: pa.Table) -> pa.Table:
        out = []
        table = table.sort_by([("stream", "ascending"), ("idx", "ascending")])
        stream = table["stream"].to_numpy()
        edges = np.flatnonzero(np.diff(stream, prepend=stream[:1] - 1, append=stream[-1:] + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            body = length(b - a)
            for t, x in zip(table["t"][a:b].to_pylist(), table["x"][a:b].to_pylist(), strict=True):
                body += (b"\0" if t is None else b"\x08" + struct.pack("<d", t)) + struct.pack(f"<{len(x)}d", *x)
            out.append(chunk(3, int(stream[a]), body))
        return pa.table({"recording": table["recording"][:1], "at": table["at"][:1], "value": pa.array([b"".join(out) + end], pa.binary())})

    def begin(table: pa.Table) -> pa.Table:
        found = [chunk(2, s, x.encode()) for s, x in sorted(zip(table["stream"].to_pylist(), table["xml"].to_pylist(), strict=True))]
        return pa.table({"recording": table["recording"][:1], "at": pa.array([-1], pa.int64()), "value": pa.array([MAGIC + b"".join(found) + end], pa.binary())})

    schema = f"recording {kind}, at bigint, value binary"
    rows = samples.select("recording", F.floor(F.col("idx") / per).cast("bigint").alias("at"), F.col("stream").cast("bigint").alias("stream"), "idx", F.col("t").cast("double").alias("t"), F.col("x").cast("array<double>").alias("x"))
    return rows.groupBy("recording", "at").applyInArrow(pack, schema).unionByName(heads.select("recording", F.col("stream").cast("bigint").alias("stream"), "xml").groupBy("recording").applyInArrow(begin, schema))


def write(segments: DataFrame, path: str) -> None:
    """Write packed() segments to a container for each recording, path/recording=.../part-*, by Spark's text writer."""
    rows = segments.repartition("recording").sortWithinPartitions("recording", "at")
    rows.select("recording", F.col("value").cast("string").alias("value")).write.partitionBy("recording").options(lineSep=BOUNDARY.decode("latin-1"), encoding="ISO-8859-1").text(path)


def header(name: str, kind: str, channels: int, rate: float, fmt: str = "double64") -> str:
    """A stream's header."""
    info = ET.Element("info")
    for tag, value in (("name", name), ("type", kind), ("channel_count", channels), ("nominal_srate", rate), ("channel_format", fmt)):
        ET.SubElement(info, tag).text = str(value)
    return ET.tostring(info, "unicode")
