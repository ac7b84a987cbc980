"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is LANES minimal hashes of its shingle set, 16 bits of each, in chunks of four.  If two
signatures differ in at most MAX_DISTANCE = 2 * chunks - 1 lanes, some chunk differs in one lane at most
(pigeonhole), so enumerating the four ways to leave one lane of a chunk out yields keys of which such a
pair shares one.  Documents with the same set are one class before that.  Candidates are confirmed on the full sets.

A key that many classes share does not make all their pairs.  First every class is compared with the least
class of each of its keys, its centre; confirmed links join components.  What is left are keys whose classes
are in different components.  Their classes' sets are written as what they have beyond the centre's set and what they
lack of it, from which the overlap of any two follows exactly:

    |x & y| = |c| - |c - x| - |c - y| + |(c - x) & (c - y)| + |(x - c) & (y - c)|

The least class outside the key's largest component is a second centre, for a group whose first one stands apart.
Then the pairs across components follow, those of the classes outside the largest one; the join's condition
is the link itself, so only links come out of it, and what the largest component has within it is never enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import delete, only, small_batches, written
from .textbytes import NOT_SPACE, combine, mix, slices, words

CHUNKS, LANES = 8, 32
MAX_DISTANCE = 2 * CHUNKS - 1

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mix(np.arange(1, LANES + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_OFFSETS = mix(np.arange(1001, LANES + 1001, dtype=np.uint64) * _GOLDEN)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, sorted within each row; start of each row and the end)."""
    h, _, first = words(data, offsets, NOT_SPACE)
    n = np.diff(first)
    run = h
    for k in range(1, size):
        run = combine(run[: max(0, len(h) - k)], h[k:])
    sets = []
    for i, m in enumerate(n.tolist()):
        if m >= size:
            sets.append(np.unique(run[first[i] : first[i + 1] - size + 1]))
        elif m:
            sets.append(reduce(combine, [h[first[i] + k : first[i] + k + 1] for k in range(m)]) ^ np.uint64(m))
        else:
            sets.append(h[:0])
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _signatures(size: int):
    names = ["doc_id", "n_shingles", "set_a", "set_b", *(f"c{k}" for k in range(CHUNKS))]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch):
                x, first = shingle_sets(data, offsets, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                starts = first[full]
                out = np.zeros((hi - lo, 2 + CHUNKS), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    if len(full):
                        out[full, 0] = np.add.reduceat(mix(x ^ _GOLDEN), starts)
                        out[full, 1] = np.add.reduceat(mix(x + _GOLDEN), starts)
                        for k in range(LANES):
                            lane = mix(np.minimum.reduceat((x ^ _OFFSETS[k]) * _FACTORS[k], starts)) & np.uint64(0xFFFF)
                            out[full, 2 + k // 4] |= lane << np.uint64(16 * (k % 4))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), *(pa.array(out[:, c].view(np.int64)) for c in range(2 + CHUNKS))], schema=schema)

    return scan, ", ".join(f"{n} long" for n in names)


def _sets(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch):
                x, first = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.view(np.int64)))], schema=schema)

    return scan, "doc_id long, shingles array<long>"


def _pairs_of_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (centre, rep) with the shingles of both, sc and sr."""
    return pairs.join(sets.select(F.col("doc_id").alias("centre"), F.col("shingles").alias("sc")), "centre").join(sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("sr")), "rep")


def _links(common: Column, sizes: Column, percent: int) -> Column:
    """Whether so many common shingles, of sets of so many together, make a link."""
    return common * (100 + percent) >= sizes * percent


def _crossing(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (key, rep, others) of the keys with classes of several components, with component and whether it is not the key's largest."""
    labelled = rows.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("many"))
    return labelled.join(sizes.where("many > 1").select("key", "main"), "key").withColumn("out", F.col("component") != F.col("main")).drop("main")


def _across(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """a, b: the links between two sides of _crossing() rows with what they have beyond their key's centre, others, and lack of it, missing."""
    x, y = (side.select("key", *(F.col(c).alias(f"{c}_{name}") for c in ("rep", "component", "out", "n", "nc", "missing", "others"))) for side, name in ((x, "x"), (y, "y")))
    base, sizes = F.col("nc_x") - F.size("missing_x") - F.size("missing_y"), F.col("n_x") + F.col("n_y")
    most = base + F.least(F.size("missing_x"), F.size("missing_y")) + F.least(F.size("others_x"), F.size("others_y"))
    exact = base + F.size(F.array_intersect("missing_x", "missing_y")) + F.size(F.array_intersect("others_x", "others_y"))
    once = ~F.col("out_y") | (F.col("rep_x") < F.col("rep_y"))
    both = x.join(y, (x["key"] == y["key"]) & once & (F.col("component_x") != F.col("component_y")) & _links(most, sizes, percent) & _links(exact, sizes, percent))
    return both.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"))


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of documents.

    Links are pairs whose shingle sets have 100 * intersection >= percent * union.  component_id is the
    least doc_id that links reach, the document's own included; kept says that it is the document's own.
    A null or empty text has no shingles and is linked with nothing.  Rows that repeat a doc_id count as one
    document.  Rows without a doc_id are linked with nothing: their component_id is null and they are kept.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scan, schema = _signatures(shingle)
    signed = written(small_batches(docs).mapInArrow(scan, schema), "signatures")
    chunks = [f"c{k}" for k in range(CHUNKS)]
    classes = signed.where("doc_id is not null and n_shingles > 0").groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in chunks))
    reps = written(classes, "classes")
    lanes = [F.xxhash64(F.col(c).bitwiseAND(F.lit(~(0xFFFF << 16 * s) if s < 3 else (1 << 48) - 1)), F.lit(4 * k + s)) for k, c in enumerate(chunks) for s in range(4)]
    keys = reps.select("rep", F.explode(F.array(*lanes)).alias("key"))
    centres = keys.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("many")).where("many > 1").drop("many")
    shared = written(keys.join(centres, "key"), "keys")
    near = written(shared.where("centre <> rep").select("centre", "rep").distinct(), "candidates")
    scan, schema = _sets(shingle)
    ids = written(near.select("centre").union(near.select("rep")).distinct().withColumnRenamed("centre", "doc_id"), "ids")
    sets = written(small_batches(only(docs, ids, "doc_id").distinct()).mapInArrow(scan, schema), "sets")
    linked = _links(F.size(F.array_intersect("sc", "sr")), F.size("sc") + F.size("sr"), percent)
    links = written(_pairs_of_sets(near, sets).where(linked).select(F.col("centre").alias("a"), F.col("rep").alias("b")), "links")
    found = written(components(links), "components")

    mixed = written(_crossing(shared, found).where("centre <> rep").select("key", "centre", "rep"), "mixed")
    some = written(mixed.select("centre").union(mixed.select("rep")).distinct().withColumnRenamed("centre", "doc_id"), "ids")
    apart = _pairs_of_sets(mixed.select("centre", "rep").distinct(), only(sets, some, "doc_id"))
    apart = apart.select("centre", "rep", F.size("sr").alias("n"), F.size("sc").alias("nc"), F.array_except("sc", "sr").alias("missing"), F.array_except("sr", "sc").alias("others"))
    member = written(mixed.join(apart, ["centre", "rep"]).drop("centre"), "members")
    for centre in (True, False):
        rows = _crossing(member, found)
        side = rows.where("out")
        if centre:
            least = side.groupBy("key").agg(F.min("rep").alias("rep"))
            side = side.join(least, ["key", "rep"])
            rows = rows.join(least.withColumnRenamed("rep", "lead"), "key").where(F.col("rep") != F.col("lead")).withColumn("out", F.lit(False))
        more = written(_across(side, rows, percent).distinct(), "links")
        if not more.isEmpty():
            links = links.union(more)
            found = written(components(links), "components")
    delete(shared, near, ids, sets, mixed, some, member)

    known = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    ids = reps.select("set_a", "set_b", F.col("n").alias("n_shingles"), "rep")
    ids = ids.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = known.join(ids, ["set_a", "set_b", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
