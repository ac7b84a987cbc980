"""Mixing sources to target weights by pivotal rounding.

Sources share all words by their weights.  A source's target is a share of the whole, up to a multiple of what
the source has; what is over goes to the others by weight, again and again, until none is above.  A document is then
expected target / size of its source times, which is a whole number of copies and a fraction left.

The fractions are rounded dependently.  Two documents of a source trade words: one gets them, the other gives as
many, until a probability of copying is 0 or 1; which way is drawn such that both keep their expectation.  So a source's
expected words stay what they are, and of all its documents one fraction is left.  Documents trade in groups, cut by
the hashes of the documents; the one that each group leaves goes up a tree, where groups of groups trade, until
one a source remains, which is drawn by itself.  Within a group large documents trade first, so what is left is small.

A task walks its groups row by row, with one open fraction in hand, so a group may have any size.  Rows alike are
one item with a number of rows: its whole expected copies are dealt at once, and only their fraction trades.
All draws are hashes of the items, so a result depends on the rows and the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import delete, sized, written

WEIGHTS, MOST = (1, 2, 3), 3
#: Items of a group at the foot of the tree, roughly, and bits by which a level has fewer groups.
LEAF, BITS = 4096, 6
#: Rows alike that become rows again together.
CHUNK = 4096

_SPACE = r"\x20\x09-\x0D"


def size_of(text: Column) -> Column:
    """The number of a text's longest runs of characters other than white space (space and 9 to 13); null has none."""
    short = F.regexp_replace(text, f"[^{_SPACE}]+", "x")  # a letter for each word
    return F.coalesce(F.length(F.translate(short, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def items(documents: DataFrame) -> DataFrame:
    """source, doc_id, size, hash (of the text) and rows: how many rows of documents are alike in these."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("source").cast("string").alias("source"), F.col("doc_id"), size_of(text).alias("size"), F.xxhash64(text).alias("hash"))
    return rows.groupBy("source", "doc_id", "size", "hash").agg(F.count("*").alias("rows"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0, in the order of code points, null last; as many tasks as Spark makes ranges."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = written(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # a row for each range
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.withColumn("within", within).join(F.broadcast(before), "part").select(*sources.columns, (F.col("before") + F.col("within")).alias("rank"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, rank, weight and target of sources (source, source_size), whose weights repeat in their order.

    With a common level, a target is weight * level or `most` times source_size, whichever is less; the level at which
    the targets make up all sizes is found by leaving out the sources that are above, until none is.
    """
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int")).cast("long")
    found = written(ranked(sizes).withColumns({"weight": weight, "cap": F.col("source_size") * most}), "weights")
    total, rest = found.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, above = (total / rest if rest else 0.0), 0
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(level)
        n, caps, rest = found.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == above or not rest:
            return found.select("source", "source_size", "rank", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))
        level, above = (total - caps) / rest, n


def uniform(key: Column, level: int, seed: int) -> Column:
    """A number in [0, 1) by the hash of a key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(seed)), 11) / float(1 << 53)


def _trade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, rank, bucket, key, size, p, u) in the order of groups with up: 1 or 0, or null for the one that a group leaves, whose p is what is left."""
    held = None  # the row in hand
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        rank, bucket, size, p, u = (table[c].to_pylist() for c in ("rank", "bucket", "size", "p", "u"))
        up: list[int | None] = [None] * len(p)
        hand = 0
        for i in range(1, len(p)):
            if hand is None or rank[i] != rank[hand] or bucket[i] != bucket[hand]:
                hand = i
                continue
            a, b = p[hand], p[i]
            s, t = size[hand], size[i]
            gain, loss = min((1 - a) * s, b * t), min(a * s, (1 - b) * t)  # of words, by the one in hand
            if u[i] * (gain + loss) < loss:
                gives, moved = b * t <= (1 - a) * s, gain
                a, b = (a + moved / s, 0.0) if gives else (1.0, b - moved / t)
            else:
                gives, moved = a * s <= (1 - b) * t, loss
                a, b = (0.0, b + moved / t) if gives else (a - moved / s, 1.0)
            p[hand], p[i] = a, b
            one, other = (hand, i) if a in (0.0, 1.0) else (i, hand)
            up[one] = int(p[one])
            hand = other
            if not 1e-9 < p[hand] < 1 - 1e-9:  # both at once
                up[hand] = round(p[hand])
                hand = None
        table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
        table = table.append_column("up", pa.array(up, pa.int32()))
        out = table if hand is None else pa.concat_tables([table.slice(0, hand), table.slice(hand + 1)])
        held = None if hand is None else table.slice(hand, 1).drop_columns(["up"])
        yield from out.drop_columns(["u"]).combine_chunks().to_batches()
    if held is not None:
        yield from held.append_column("up", pa.array([None], pa.int32())).drop_columns(["u"]).to_batches()


def rounded(open_: DataFrame, n: int, seed: int = 0, leaf: int = LEAF, bits: int = BITS) -> DataFrame:
    """id and up (1 or 0) of n items (id, rank, key, size, p) with 0 < p < 1: p rounded such that size * p, over a rank's items, stays what it is but for one item."""
    depth = max(0, (n // leaf).bit_length())
    depth = -(-depth // bits) * bits
    rows, done, level = open_, None, 0
    while True:
        bucket = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0)
        dealt = rows.select("id", "rank", bucket.cast("long").alias("bucket"), "key", "size", "p", uniform(F.col("key"), level, seed).alias("u"))
        dealt = dealt.repartition("rank", "bucket").sortWithinPartitions("rank", "bucket", F.desc("size"), "key", "id")
        traded = written(dealt.mapInArrow(_trade, "id long, rank long, bucket long, key long, size long, p double, up int"), "traded")
        some = traded.where("up is not null").select("id", "up")
        done = some if done is None else done.unionByName(some)
        rows = traded.where("up is null")
        if not depth:
            last = (uniform(F.col("key"), level + 1, seed) < F.col("p")).cast("int")
            return done.unionByName(rows.select("id", last.alias("up")))
        depth, level = depth - bits, level + 1


def mixed(documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0, leaf: int = LEAF, bits: int = BITS) -> DataFrame:
    """source, doc_id, size, hash, rows, source_size, target, copies and more: a row for each item of documents.

    Each of an item's rows is taken `copies` times, and the first `more` of them once more.  The words taken of a source
    are its target but for one document.  Sources without words, and documents without, take nothing; null is a source
    of its own, the last.  Rows without a doc_id, and rows that repeat one, are items by their text and size.
    """
    parts = written(items(documents), "items")
    sizes = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    of_source = written(targets(sizes, weights, most), "targets")
    right = sized(of_source).withColumnRenamed("source", "_source")
    key = F.xxhash64("source", "doc_id", "size", "hash", F.lit(seed))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    all_ = parts.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", rate)
    whole = F.floor("rate").cast("long")
    rest = F.when(F.col("size") > 0, F.col("rows") * (F.col("rate") - whole)).otherwise(0.0)
    all_ = all_.select(F.monotonically_increasing_id().alias("id"), "source", "doc_id", "size", "hash", "rows", "source_size", "target", "rank", key.alias("key"), whole.alias("copies"), rest.alias("rest"))
    all_ = written(all_.withColumn("more", F.floor("rest").cast("long")).withColumn("p", F.col("rest") - F.col("more")), "all")
    open_ = all_.where("p > 1e-9 and p < 1 - 1e-9").select("id", "rank", "key", "size", "p")
    up = rounded(open_, open_.count(), seed, leaf, bits)
    delete(parts)
    found = all_.join(up, "id", "left")
    more = F.col("more") + F.coalesce("up", F.round("p").cast("long"))  # what was as good as whole is whole
    return found.select("source", "doc_id", "size", "hash", "rows", "source_size", "target", "copies", more.alias("more"))


def taken(mix_: DataFrame) -> DataFrame:
    """source, doc_id, size, source_size, target and taken, the words the mix takes of it: a row for each row of the documents."""
    parts = mix_.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK) * CHUNK, F.lit(CHUNK).cast("long"))))
    parts = parts.where(F.col("rows") <= CHUNK).unionByName(parts.where(F.col("rows") > CHUNK).repartition("source", "doc_id", "hash", "from"))
    row = F.explode(F.sequence("from", F.least(F.col("from") + CHUNK, F.col("rows")) - 1))
    rows = parts.withColumn("row", row)
    return rows.select("source", "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + (F.col("row") < F.col("more")).cast("int"))).alias("taken"))


def copied(documents: DataFrame, mix_: DataFrame) -> DataFrame:
    """Each row of documents as often as the mix takes it; of rows alike all copies together."""
    text = F.col("text").cast("string")
    known = documents.withColumns({"_source": F.col("source").cast("string"), "_hash": F.xxhash64(text), "_size": size_of(text)})
    own = known.dropDuplicates(["_source", "doc_id", "_size", "_hash"])
    often = mix_.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("hash").alias("_h"), F.col("size").alias("_z"), (F.col("rows") * F.col("copies") + F.col("more")).alias("_n")).where("_n > 0")
    same = F.col("_source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")) & (F.col("_size") == F.col("_z"))
    return own.join(often, same).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*(F.col(f"`{c}`") for c in documents.columns))
