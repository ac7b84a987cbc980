"""Document fingerprints: a sketch that keeps every shingle hash below a fixed fraction of the hash range.

Whether a hash is kept does not depend on the document, so the sketch of a union is the union of sketches,
and the share of a short document's kept hashes that a long one has estimates its containment.  Only
DataFrame functions are used.  A text's words are its lower-cased runs of characters other than white
space; a shingle is `size` words, and a text of fewer, but not none, is one shingle.  Beside the kept hashes
a sketch has the least hash of all, which also unites by its rule (the lesser of two) and tells texts apart that are
too short to have kept ones.  Null and empty texts have no hashes and a null least one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One of this many hashes is kept.
SCALE = 8
#: Documents that one group of the order by doc_id holds, roughly, and the most groups there are.
GROUP, GROUPS = 2000, 10_000


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles, one for each position."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
        return F.when(n >= size, full).when(n > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))).otherwise(F.array().cast("array<bigint>"))

    # bound by a lambda, so that the words are hashed once
    return F.flatten(F.transform(F.array(hashes), shingles))


def fingerprint(text: Column, size: int = SHINGLE, scale: int = SCALE) -> Column:
    """kept: sorted distinct hashes h with 0 <= h < 2^64 / scale, where scale is 2 at least; least: the least hash."""
    below = (1 << 64) // scale

    def sketch(h: Column) -> Column:
        return F.struct(F.array_sort(F.array_distinct(F.filter(h, lambda x: (x >= 0) & (x < below)))).alias("kept"), F.array_min(h).alias("least"))

    return F.element_at(F.transform(F.array(shingle_hashes(text, size)), sketch), 1)


def _both(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    return tuple(F.col(x) if isinstance(x, str) else x for x in (a, b))


def as_text(sketch: str | Column) -> Column:
    """Hexadecimal hashes joined by dots, those kept and, after a colon, the least; equal sketches have equal texts, and an empty one none."""
    sketch, _ = _both(sketch, sketch)
    return F.concat(F.array_join(F.transform(sketch["kept"], lambda x: F.lower(F.hex(x))), "."), F.coalesce(F.concat(F.lit(":"), F.lower(F.hex(sketch["least"]))), F.lit("")))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated share of the shingles of either text that both have; without kept hashes, whether the least are the same (1 for two empty texts)."""
    a, b = _both(a, b)
    common, both = F.size(F.array_intersect(a["kept"], b["kept"])), F.size(F.array_union(a["kept"], b["kept"]))
    return F.when(both == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(common / F.greatest(both, F.lit(1)))


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated share of the shingles of a's text that b's has; 1 if there are none.

    Without kept hashes it is 1 if both have the same least one, else 0, as a's few shingles cannot be looked for.
    """
    a, b = _both(a, b)
    few = F.when(a["least"].isNull() | a["least"].eqNullSafe(b["least"]), 1.0).otherwise(0.0)
    return F.when(F.size(a["kept"]) == 0, few).otherwise(F.size(F.array_intersect(a["kept"], b["kept"])) / F.greatest(F.size(a["kept"]), F.lit(1)))


def merged(a: str | Column, b: str | Column) -> Column:
    """The sketch of two texts' shingles together."""
    a, b = _both(a, b)
    return F.struct(F.array_sort(F.array_union(a["kept"], b["kept"])).alias("kept"), F.least(a["least"], b["least"]).alias("least"))


def with_next(documents: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, text (null: empty), n_chars and next_text: the text after it in descending order of doc_id, after the last the first.

    Rows without a doc_id are last; rows with the same doc_id follow each other in the order of their texts.
    The rows are put into groups by quantiles of doc_id, which one pass estimates, and each group looks
    within itself; only the first text of each group goes to the group before.  All rows of one doc_id
    are in one group.  A single document is its own next.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    groups = max(1, min(GROUPS, n // group))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / groups for k in range(1, groups)], 10 * groups)).first()[0] if groups > 1 else None
    cuts = sorted(set(cuts or []))
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    sorted_cuts, n_cuts = F.array(*map(F.lit, cuts)).cast("array<bigint>"), F.lit(len(cuts))

    def search(found: Column, step: Column) -> Column:  # by halves: how many cuts are below doc_id
        return F.when((found + step <= n_cuts) & (F.get(sorted_cuts, found + step - 1) < F.col("doc_id")), found + step).otherwise(found)

    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search) if cuts else F.lit(0)
    docs = docs.withColumn("part", F.coalesce(n_cuts - below, n_cuts + 1))  # the greatest ids are in part 0
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), n_cuts + 1).otherwise(F.col("part")))

    top = docs.groupBy("part").agg(F.max("doc_id").alias("top"))
    heads = docs.join(F.broadcast(top.withColumnRenamed("part", "_part")), (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("top")))  # GROUPS + 1 rows at most
    heads = heads.groupBy("part").agg(F.min("text").alias("head"))
    ring = Window.orderBy("part")  # of at most GROUPS + 1 numbers
    after = top.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("after"))
    heads = after.join(heads.withColumnRenamed("part", "after"), "after").select("part", "head")
    following = F.lead("text").over(Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.asc("text")))
    docs = docs.withColumns({"following": following, "n_chars": F.length("text").cast("long")})
    return docs.join(heads, "part").select("doc_id", "text", "n_chars", F.coalesce("following", "head").alias("next_text"))
