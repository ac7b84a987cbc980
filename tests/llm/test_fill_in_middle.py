"""Fill-in-the-middle against a plain Python version, and on odd rows."""

import hashlib

from pyspark.sql import functions as F

from sonarframe.llm import fill_in_middle as fim
from sonarframe.llm import queries

from .test_text_operators import clashing, empty, odd_rows, table


def plainly(doc_id, text):
    """(n, form, prefix, middle, suffix, output) by the definition."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    if h[3] % 100 < 20:
        return n, "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}"


def fixture():
    marks = [f"{fim.MARK}a{fim.ESCAPE}", f"{fim.ESCAPE}0{fim.MARK}1{fim.ESCAPE}{fim.ESCAPE}1", fim.ESCAPE, fim.MARK * 5, f"{fim.ESCAPE}" * 7 + "01", "$0 \\1 ${x} \\", "\U0001f600" * 9 + "é́\x00\r\n", "<P", "a<S", "<<M", "x<P>y", "<S>", "z<M>", "< P>"]
    return odd_rows() + [(100 + k, t) for k, t in enumerate(marks * 12)]


def test_equals_the_plain_version(spark):
    rows = fixture()
    found = fim.transformed(clashing(table(spark, rows)), "doc_id", "text").withColumn("back", fim.restored("output", "form")).collect()
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) for r in found), key=repr)
    assert got == sorted(((i, t, *plainly(i, t)) for i, t in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    for r in found:
        if r["form"] == "plain":
            assert r["first"] is None and r["end"] is None
        else:
            assert (r["first"], r["end"]) == (len(r["prefix"]), len(r["prefix"]) + len(r["middle"]))


def test_borders_and_escapes(spark):
    """Every pair of borders of texts that are made of the signs themselves."""
    texts = ["", fim.MARK, f"{fim.ESCAPE}1{fim.MARK}", f"1{fim.ESCAPE}{fim.ESCAPE}{fim.MARK}0é"]
    rows = [(t, a, b) for t in texts for a in range(len(t) + 1) for b in range(a, len(t) + 1)]
    df = spark.createDataFrame(rows, "t string, a bigint, b bigint").withColumn("m", fim.marked(F.col("t"))).withColumn("n", fim.count(F.col("m")))
    parts = df.select("t", "a", "b", "n", F.struct(*(x.alias(c) for x, c in zip(fim.cut(F.col("m"), F.col("n"), F.col("a"), F.col("b")), "xyz", strict=True))).alias("p")).collect()
    assert all((r["n"], *r["p"]) == (len(r["t"]), r["t"][: r["a"]], r["t"][r["a"] : r["b"]], r["t"][r["b"] :]) for r in parts) and len(parts) == len(rows)


def test_units_may_be_words(spark):
    text = f"one  two{fim.MARK}{fim.ESCAPE}\nthree four \t "
    rows = fim.transformed(table(spark, [(k, text) for k in range(200)]), unit=fim.WORDS, plain=0, spm=50).collect()
    units = ["one", f"  two{fim.MARK}{fim.ESCAPE}", "\nthree", " four", " \t "]
    assert {r["n"] for r in rows} == {5} and {r["form"] for r in rows} == {"psm", "spm"}
    for r in rows:
        assert (r["prefix"], r["middle"], r["suffix"]) == ("".join(units[: r["first"]]), "".join(units[r["first"] : r["end"]]), "".join(units[r["end"] :]))


def test_the_query(spark, sf_dir):
    rows = queries.op11_fill_in_middle(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, _, output = plainly(r["doc_id"], texts[r["doc_id"]])
        chars = (None, None) if form == "plain" else (len(prefix), len(middle))
        assert (r["n"], r["form"], (r["prefix_chars"], r["middle_chars"]), r["output_sha256"], r["restored_sha256"]) == (n, form, chars, sha(output), sha(texts[r["doc_id"]] or ""))


def test_an_empty_table(spark):
    assert fim.transformed(empty(spark), "doc_id").collect() == []
