"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

A line's form is the line in lower case, white space trimmed.  A form of length n is cut into DISTANCE + 1
segments, whose lengths depend on n alone.  Of two forms within DISTANCE edits, one has a segment of the
other, unchanged and shifted by a few characters at most, so each form probes the index of the segments
with those of its substrings that a segment of a form as long, or shorter by up to DISTANCE, could match; the
positions follow the multi-match rule, which counts the edits to the left and to the right.  Two forms whose
counts of some letters differ by more than the edits allow are no candidates.  Where more than CROWD forms meet under
a key, as lines of one template do, their pairs are not made: what all of them have in common at their start and end
is left out, which changes no distance, and what remains is cut and probed in the same way, so they meet under keys
of the parts in which they differ.  Keys that are still crowded go another round, without the segment they share;
after ROUNDS rounds the pairs of what is left follow.  The others are verified
by a bit-parallel edit distance in a band of 2 * DISTANCE + 1 diagonals, DISTANCE + 1 words of bits
for each character whatever the line's length.  Equal forms are one class before all this, and forms of fewer
than LEAST characters only match equal ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import delete, fresh, only, sized, written

DISTANCE = 2
LEAST = 16
#: Forms that meet under a key before it is divided, and how often it is divided at most; neither changes what is found.
CROWD, ROUNDS = 64, 6
#: Frequent letters, whose counts tell most candidates apart before they are made.
LETTERS = "etaoinsrlhdcumpg"


def lines(documents: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, pos (from 0) and form of each line; a null text has none, an empty one an empty line.

    The forms are made before the lines become rows, so what uses them does not make them again.
    """
    forms = F.transform(F.split(F.lower(F.col("text").cast("string")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\v")))
    return documents.where("text is not null").select(*keep, F.posexplode(forms).alias("pos", "form"))


def segment(n: Column, k: Column, d: int) -> tuple[Column, Column]:
    """(start from 0, length) of segment k of a form of length n: the last segments are a character longer."""
    short, longer = (n / (d + 1)).cast("int"), n % (d + 1)
    return short * k + F.greatest(F.lit(0), k - (d + 1) + longer), short + (k >= (d + 1) - longer).cast("int")


def probes(d: int) -> list[tuple[int, int, int]]:
    """(how much shorter the indexed form is, segment, shift): k edits at most left of the segment, d - k at most right of it.

    The first of these for a segment, (0, k, 0), is the form's own entry in the index.
    """
    found = [(less, k, shift) for less in range(d + 1) for k in range(d + 1) for shift in range(max(-k, less - (d - k)), min(k, less + (d - k)) + 1)]
    return sorted(found, key=lambda p: (p[0], abs(p[2]), p))


def keys(units: str | Column, n: str | Column, d: int = DISTANCE) -> Column:
    """An array of keys, one for each of probes(d): those under which forms within d edits, of the same length or up to d shorter, are indexed.

    units is the form in UTF-32, so that a character's place is known without reading what is before it, and n its
    number of characters; both are columns of their own.  The first d + 1 keys are the form's own entries in the
    index.  Two forms meet if one has a key as an entry that the other has at all.  A probe that runs over
    the form's ends has no key (null).
    """
    units, n = (F.col(c) if isinstance(c, str) else c for c in (units, n))

    def key(less: int, k: int, shift: int) -> Column:
        m = n - less
        start, size = segment(m, F.lit(k), d)
        at = start + shift
        return F.when((at >= 0) & (at + size <= n), F.xxhash64(m, F.lit(k), F.substring(units, at * 4 + 1, size * 4)))

    return F.array(*(key(*p) for p in probes(d)))


def remainders(text: str | Column, n: str | Column, d: int = DISTANCE) -> Column:
    """An array of structs (key, entry, rest) for each of probes(d), as keys() has them: rest is the text without the segment.

    If two texts are within d edits and meet in a segment that no edit touches, so are their rests.
    """
    text, n = (F.col(c) if isinstance(c, str) else c for c in (text, n))

    def part(i: int, less: int, k: int, shift: int) -> Column:
        m = n - less
        start, size = segment(m, F.lit(k), d)
        at = start + shift
        key = F.when((m >= 0) & (at >= 0) & (at + size <= n), F.xxhash64(m, F.lit(k), F.substring(text, at + 1, size)))
        return F.struct(key.alias("key"), F.lit(i <= d).alias("entry"), F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + size + 1, n)).alias("rest"))

    return F.array(*(part(i, *p) for i, p in enumerate(probes(d))))


def _shared(a: str, b: str) -> Column:
    """How many first characters two texts have in common."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return F.when(F.col(a) == F.col(b), F.length(a)).otherwise(F.array_position(same, F.lit(False)).cast("int") - 1)


def _meeting(keyed: DataFrame, *by: str) -> DataFrame:
    """key, how many rows and how many meetings (of an entry with a row), of the keys under which different ids meet."""
    entries = F.sum(F.col("entry").cast("long"))
    met = keyed.groupBy(*by, "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("many"), (F.count("*") * entries).alias("meetings"))
    return met.where("meetings > 0 and lo <> hi").select(*by, "key", "many", "meetings")


def _divided(members: DataFrame, d: int) -> DataFrame:
    """key, id, entry: keys for the rows (key, id, entry, rest) of crowded keys, under which all meet whose rests are within d edits.

    Of each key's texts, the least and the greatest have at their start what all have, and likewise reversed at the end.
    A key stays as it is if its parts would not halve the meetings, as where most of its texts are links of each other.
    """
    found = []
    for left in reversed(range(ROUNDS)):
        back = F.reverse("rest")
        sides = F.count("*") * F.sum(F.col("entry").cast("long"))
        ends = members.groupBy("key").agg(F.min("rest").alias("a"), F.max("rest").alias("b"), F.min(back).alias("c"), F.max(back).alias("e"), F.min(F.length("rest")).alias("n"), sides.alias("meetings"))
        ends = written(ends.select("key", "n", "meetings", _shared("a", "b").alias("head"), _shared("c", "e").alias("tail")), "ends")
        bare = members.join(sized(ends.select("key", "head", F.least("tail", F.col("n") - F.col("head")).alias("tail"))), "key")
        bare = bare.select("key", "id", F.expr("substring(rest, head + 1, length(rest) - head - tail)").alias("rest")).withColumn("n", F.length("rest"))
        keyed = bare.select(F.col("key").alias("of"), "id", F.explode_outer(remainders("rest", "n", d)).alias("part")).where("part.key is not null")
        keyed = written(keyed.select("of", F.xxhash64("of", "part.key").alias("key"), "id", "part.entry", "part.rest"), "keyed")
        met = written(_meeting(keyed, "of"), "met")
        after = met.groupBy(F.col("of").alias("key")).agg(F.sum("meetings").alias("after"))
        fewer = written(ends.join(after, "key", "left").where("2 * coalesce(after, 0) <= meetings").select("key"), "fewer")
        found.append(members.join(sized(fewer), "key", "left_anti").select("key", "id", "entry"))
        rows = written(only(keyed, met.join(sized(fewer.withColumnRenamed("key", "of")), "of", "left_semi"), "key"), "divided")
        delete(keyed)
        crowded = written(only(met, fewer.withColumnRenamed("key", "of"), "of").where(F.col("many") > CROWD).select("key"), "crowded")
        found.append(rows.join(sized(crowded), "key", "left_anti").select("key", "id", "entry") if left else rows.select("key", "id", "entry"))
        if not left or crowded.isEmpty():
            break
        members = written(only(rows, crowded, "key").select("key", "id", "entry", "rest").distinct(), "members")
    return reduce(DataFrame.union, found).groupBy("key", "id").agg(F.max("entry").alias("entry"))


def letters(text: str | Column, n: str | Column) -> Column:
    """How often each of LETTERS is in the text, modulo 16, four bits for each."""
    text, n = (F.col(c) if isinstance(c, str) else c for c in (text, n))
    counts = [F.shiftleft(((n - F.length(F.replace(text, F.lit(c), F.lit("")))) % 16).cast("long"), 4 * k) for k, c in enumerate(LETTERS)]
    return reduce(lambda x, y: x.bitwiseOR(y), counts)


def may_be_near(a: Column, b: Column, d: int = DISTANCE) -> Column:
    """Whether letters() of two texts leave room for d edits: an edit changes two counts by one at most."""
    apart = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        off = F.abs(F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15)))
        apart = apart + F.least(off, 16 - off)
    return apart <= 2 * d


def within(a: Column, b: Column, d: int = DISTANCE) -> Column:
    """Whether the edit distance of two arrays of characters is d at most, by bit-parallel steps in a band.

    After i characters of a, bit k of word e says that i + k - d characters of b can be matched with at
    most e edits; only the 2 * d + 1 diagonals that d edits can reach have a bit.  A step takes the bits
    on which the next characters are equal and shifts words for the three kinds of edits.
    """
    width = 2 * d + 1
    full = F.lit((1 << width) - 1)

    def step(words: Column, i: Column) -> Column:  # i from 0
        c = F.get(a, i)
        equal = reduce(lambda x, y: x + y, [F.when(F.get(b, i + (k - d)) == c, 1 << k).otherwise(0) for k in range(width)])
        after: list[Column] = []

        def word(e: int, equal: Column) -> Column:  # each value is bound before the next uses it, so nothing is worked out twice
            own = words[f"w{e}"].bitwiseAND(equal)
            if e:
                last = words[f"w{e - 1}"]
                own = own.bitwiseOR(last).bitwiseOR(F.shiftright(last, 1)).bitwiseOR(F.shiftleft(after[-1], 1)).bitwiseAND(full)
            if e == d:
                return F.struct(*(w.alias(f"w{j}") for j, w in enumerate([*after, own])))

            def rest(w: Column) -> Column:
                after.append(w)
                return word(e + 1, equal)

            return F.element_at(F.transform(F.array(own), rest), 1)

        return F.element_at(F.transform(F.array(equal), lambda q: word(0, q)), 1)

    start = F.struct(*(F.lit(sum(1 << (d + j) for j in range(e + 1))).alias(f"w{e}") for e in range(d + 1)))
    end = F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step)[f"w{d}"]
    off = F.size(b) - F.size(a) + d
    reached = reduce(lambda x, y: x | y, [(off == k) & (end.bitwiseAND(F.lit(1 << k)) != 0) for k in range(width)])
    return F.coalesce(reached, F.lit(False))


def classes(documents: DataFrame, d: int = DISTANCE, least: int = LEAST) -> DataFrame:
    """doc_id, row, pos, class_doc_id, class_pos, copies, n_links, kept: a row for each line of documents.

    A class is made of the lines whose forms are linked, directly or over others, by at most d edits; its
    first line in the order of doc_id, row and pos names it, copies is its number of lines and n_links how many
    other forms the line's own form is linked with.  kept is false for a line of at least `least`
    characters that is not the first of its class.  Shorter lines stay.  row, a hash of the text, tells rows apart
    that share a doc_id; rows alike in both count as one document, so they keep the same lines.  Rows without a
    doc_id are first of all, and keep their lines.  Forms are told apart by 64-bit hashes of their text.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string"))
    forms = lines(docs, "doc_id", "row").select("doc_id", "row", "pos", F.xxhash64("form").alias("id"), "form", (F.length("form") >= least).alias("long"))
    lines_ = written(forms.select("doc_id", "row", "pos", "id", "long"), "lines")
    known = forms.where("long").select("id", "form", F.length("form").alias("n"))
    # the arrays are a column before they become rows, so that what the keys share is worked out once; none is empty, and outer keeps Spark from asking
    keyed = known.select("id", F.encode("form", "UTF-32").alias("units"), "n").select("id", keys("units", "n", d).alias("keys"))
    keyed = keyed.select("id", F.posexplode_outer("keys").alias("probe", "key")).where("key is not null").select("key", "id", (F.col("probe") <= d).alias("entry"))
    # keys on which different forms meet are few; only their forms go on
    met = written(_meeting(keyed), "met")
    sides = written(only(keyed, met, "key").groupBy("key", "id").agg(F.max("entry").alias("entry")), "sides")
    forms_ = written(only(known, sides, "id").groupBy("id").agg(F.first("form").alias("form")), "forms")
    # met counts the copies of a form, sides has each form once
    crowded = written(only(sides, met.where(F.col("many") > CROWD), "key").groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > CROWD).select("key"), "crowded")
    if not crowded.isEmpty():
        members = written(only(sides, crowded, "key").join(forms_.withColumnRenamed("form", "rest"), "id").select("key", "id", "entry", "rest"), "members")
        sides = written(sides.join(sized(crowded), "key", "left_anti").select("key", "id", "entry").union(_divided(members, d)), "sides")
    texts = only(forms_, sides, "id").withColumn("n", F.length("form"))
    texts = written(texts.select("id", letters("form", "n").alias("letters"), F.split("form", "").alias("chars")), "texts")
    a, b = (side.join(texts.select("id", "letters"), "id").select("key", F.col("id").alias(name), F.col("letters").alias(f"l{name}")) for side, name in ((sides.where("entry"), "a"), (sides, "b")))
    pairs = a.join(b, "key").where((F.col("a") != F.col("b")) & may_be_near(F.col("la"), F.col("lb"), d))
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("chars").alias("ca")), "a").join(texts.select(F.col("id").alias("b"), F.col("chars").alias("cb")), "b")
    links = written(both.where(within(F.col("ca"), F.col("cb"), d)).select("a", "b"), "links")
    delete(met, sides, texts, pairs)
    found = written(components(links), "components")
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = found.join(degree, "id")

    first = F.min(F.struct("doc_id", "row", "pos")).alias("first")
    own = written(lines_.groupBy("id").agg(first, F.count("*").alias("copies")), "forms")
    joint = own.join(linked, "id").groupBy("component").agg(F.min("first").alias("class_first"), F.sum("copies").alias("class_copies"))
    of_form = own.join(linked.join(joint, "component").select("id", "class_first", "class_copies", "n_links"), "id", "left")
    of_form = written(of_form.select("id", F.coalesce("class_first", "first").alias("first"), F.coalesce("class_copies", "copies").alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "forms")
    out = lines_.join(of_form, "id")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos"))
    return out.select("doc_id", "row", "pos", F.col("first.doc_id").alias("class_doc_id"), F.col("first.pos").alias("class_pos"), "copies", "n_links", (~F.col("long") | is_first | F.col("doc_id").isNull()).alias("kept"))


def deduplicated(documents: DataFrame, d: int = DISTANCE, least: int = LEAST) -> DataFrame:
    """documents with the lines left out that classes() does not keep; n_chars, if there, is counted anew.

    A document of which nothing but white space is left, though there was more, is a copy and goes.
    Other columns stay as they are, whatever their names.
    """
    doc, row, gone, rest = (fresh(c, documents.columns) for c in ("doc", "row", "gone", "rest"))
    lost = classes(documents, d, least).where("not kept").groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone))
    text = F.col("text").cast("string")
    out = documents.withColumns({doc: F.col("doc_id").cast("long"), row: F.xxhash64(text)}).join(lost, [doc, row], "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = out.withColumn(rest, F.when(F.col(gone).isNotNull(), left)).where(F.col(gone).isNull() | F.col(rest).rlike(r"\S"))
    new = {"text": F.coalesce(rest, text)}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.coalesce(F.length(rest).cast("long"), "n_chars")
    return out.select(*(new[c].cast(documents.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in documents.columns))
