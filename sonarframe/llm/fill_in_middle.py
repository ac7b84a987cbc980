"""Fill-in-the-middle by escaped marker injection, in built-in functions only.

A text is cut into units.  A mark that no text has is put after each unit: the mark itself and the sign that
escapes it are escaped first, so the marks of the marked text are those put there, and their number is the number
of units.  The parts between two ranks come out of it as what lies before and after so many marks; marks are
then taken out and escapes undone.  A part is cut and put together without the text becoming an array or rows.

    psm: <P> prefix <S> suffix <M> middle        spm: <S> suffix <P> prefix <M> middle        plain: the text

A text with one of the three tokens stays plain, so a token ends its part wherever it is found, and the text
can be built again from the output and its form alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, ESCAPE = "\u001f", "\u001b"
#: Units, as patterns over escaped text, where ESCAPE and the digit after it are one character of the text.
CODE_POINTS = f"(?s){ESCAPE}?."
WORDS = r"\s*\S+|\s+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, those that stay plain, and of a hundred others those with the suffix in front.
PLAIN, SPM = 10, 20


def escaped(text: Column) -> Column:
    """The text without MARK: ESCAPE is written ESCAPE 0, and MARK is written ESCAPE 1."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(MARK), F.lit(f"{ESCAPE}1"))


def unescaped(text: Column) -> Column:
    """What escaped() was given.  Each ESCAPE of its result has its digit, so one digit is undone after the other."""
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}1"), F.lit(MARK)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def marked(text: Column, unit: str = CODE_POINTS) -> Column:
    """The escaped text with MARK after each unit."""
    return F.regexp_replace(escaped(text), unit, f"$0{MARK}")


def count(marks: Column) -> Column:
    """How many units a marked text has."""
    return (F.length(marks) - F.length(F.replace(marks, F.lit(MARK), F.lit("")))).cast("long")


def _upto(text: Column, sign: str, n: Column | int) -> Column:
    """What is before the n-th sign, or behind the n-th from the end if n < 0; F.substring_index takes no column as n."""
    return F.call_function("substring_index", text, F.lit(sign), n if isinstance(n, Column) else F.lit(n))


def cut(marks: Column, n: Column, first: Column, end: Column) -> tuple[Column, Column, Column]:
    """The units before `first`, those from there to `end`, and the rest, of a marked text of n units; 0 <= first <= end <= n."""
    first, end, n = first.cast("int"), end.cast("int"), n.cast("int")

    def part(x: Column) -> Column:
        return unescaped(F.replace(x, F.lit(MARK), F.lit("")))

    # the last mark of a marked text is its end, so counted from behind there is one more
    return part(_upto(marks, MARK, first)), part(_upto(_upto(marks, MARK, end), MARK, first - end)), part(_upto(marks, MARK, end - n - 1))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32: the first 8-digit groups of the hexadecimal SHA-256 of `seed:key`; a null key is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def assembled(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The output of a form: the three parts behind their tokens, or the text."""
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output of this form was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(a: str, b: str) -> Column:
        return _upto(_upto(output, b, 1), a, -1)

    middle = _upto(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transformed(documents: DataFrame, *keep: str, key: str = "doc_id", unit: str = CODE_POINTS, plain: int = PLAIN, spm: int = SPM, seed: int = 1) -> DataFrame:
    """The columns to keep, n (units), form (plain, psm or spm), first and end (units before and up to the end of the middle), prefix, middle, suffix (null if plain), output.

    The borders, and the form, are drawn from the key of each row, so they are the same in every run; rows that
    repeat a key with texts of as many units are cut alike.  Null texts are empty, and empty texts are plain.
    What a unit's pattern does not match goes with the unit after it, at the end with the last part.
    """
    h1, h2, h3, h4 = draws(F.col(key), seed)
    rows = documents.select(*(F.col(c) for c in keep), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"), F.array(h1, h2, h3, h4).alias("_h"))
    rows = rows.withColumn("_marked", marked(F.col("_text"), unit))
    rows = rows.withColumn("_n", count(F.col("_marked")))
    a, b = (F.get("_h", F.lit(k)) % (F.col("_n") + 1) for k in (0, 1))
    stays = (F.col("_text") == "") | (F.get("_h", F.lit(2)) % 100 >= 100 - plain)
    for token in (PREFIX, SUFFIX, MIDDLE):
        stays = stays | F.contains("_text", F.lit(token))
    form = F.when(stays, "plain").when(F.get("_h", F.lit(3)) % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumns({"_form": form, "_first": F.least(a, b), "_end": F.greatest(a, b)})
    parts = F.when(F.col("_form") != "plain", F.struct(*(x.alias(c) for x, c in zip(cut(F.col("_marked"), F.col("_n"), F.col("_first"), F.col("_end")), ("prefix", "middle", "suffix"), strict=True))))
    rows = rows.withColumn("_parts", parts)
    prefix, middle, suffix = (F.col(f"_parts.{c}") for c in ("prefix", "middle", "suffix"))
    borders = (F.when(F.col("_form") != "plain", F.col(c)).alias(c[1:]) for c in ("_first", "_end"))
    return rows.select(*keep, F.col("_n").alias("n"), F.col("_form").alias("form"), *borders, prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), assembled(F.col("_form"), F.col("_text"), prefix, middle, suffix).alias("output"))
