"""Spelling variants against brute force, and on odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarframe.llm import queries, spelling

from .test_text_operators import clashing, empty, odd_rows, table


def is_near(a, b):
    """Whether one insertion, deletion or replacement makes a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plainly(counts, times=10):
    """The rows of variants() by comparing every two words."""
    near = {w: [o for o in counts if is_near(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def test_equals_brute_force(spark):
    """Words over few letters, so that all kinds of neighbours, ties and chains occur."""
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abß÷é"), rng.integers(1, 6))) for _ in range(400)}
    counts = {w: int(rng.choice([1, 2, 10, 20, 100, 200, 1000, 10_000])) for w in words}
    for k, w in enumerate(["chainedd", "chained", "chaine", "chain", "chai"]):
        counts[w] = 2 * 10**k
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()
    want = plainly(counts)
    assert len(got) == len(counts) and {tuple(r) for r in got} == want
    assert next(r for r in got if r["word"] == "chainedd")["root"] == "chai" and len({r[2] for r in want}) > 10


def test_query_on_a_fixture(spark, tmp_path):
    rng = np.random.default_rng(2)
    vocabulary = ["Question", "HARBOURS", "größeren", "lanterns", "ÉCHELLES", "straßen", "÷÷÷÷÷÷÷÷", "shortly", "tiny"]
    rows = [(k, " ".join(rng.choice(vocabulary, 40)) + f" é{k}") for k in range(300)] + odd_rows() + [(400, "solitary questiom questiom"), (401, "questiom" * 30_000), (402, "questiom" * 30_000)]
    clashing(table(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            run = run if h % 31 else run[:at] + run[at + 1 :]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    found = queries.op12_spelling(spark, str(tmp_path))
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    got = found.collect()
    assert {tuple(r) for r in got} == plainly(counts) and len(got) == len(counts)
    assert {"harbours", "Échelles", "questio", "questiom" * 30_000} <= {r["word"] for r in got} and any(r["form"] for r in got)


def test_keys_of_a_long_word_are_few_and_as_by_definition(spark):
    word = "ab" * 3 + "cc" + "é"
    which, keys = spelling.deletion_keys(np.frombuffer((word + "x" * 100_000).encode(), np.uint8), np.array([0, len(word.encode()), len(word.encode()) + 100_000]))
    alone = {w: spelling.deletion_keys(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[1][0] for w in [word[:k] + word[k + 1 :] for k in range(len(word))] + [word]}
    assert set(keys[which == 0].tolist()) == {int(k) for k in alone.values()} and (which == 0).sum() == len(alone)
    assert (which == 1).sum() == 2


@pytest.mark.parametrize("n", [0, 1])
def test_few_words(spark, n):
    counts = spark.createDataFrame([("lonely words"[:8], 5), (None, 3)][: 2 * n], "word string, n bigint")
    assert [tuple(r) for r in spelling.variants(counts).collect()] == [("lonely w", None, "lonely w", 5, 0, None)] * n
    assert spelling.runs(empty(spark), "doc_id").count() == 0


def test_lowering(spark):
    got = spark.createDataFrame([("ABCZ",), ("ÉaÀZ",), ("",), (None,)], "t string").select(spelling.lowered(F.col("t"))).collect()
    assert [r[0] for r in got] == ["abcz", "ÉaÀz", "", None]
