"""Mixing sources: targets by hand, words kept by rounding, expectations over many draws, and odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from sonarframe.llm import mixture, queries

from .test_text_operators import SCHEMA, odd_rows


def target_of(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing out, again and again, what is above the limit."""
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def drawn(n=3000):
    rng = np.random.default_rng(3)
    names = ["b", "a", "cé", None, "tiny", "Z", ""]
    share = [0.4, 0.2, 0.15, 0.1, 0.01, 0.1, 0.04]
    return [(k, "w " * int(rng.pareto(1.2) * 10 + rng.integers(0, 2)), names[rng.choice(7, p=share)]) for k in range(n)]


def check(rows, got):
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len((t or "").split())
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want, taken = target_of(sizes), Counter()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((i, len((t or "").split()), s) for i, t, s in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        copies = r["taken"] / r["size"] if r["size"] else 0
        assert copies == int(copies) and abs(copies - (r["target"] / r["source_size"] if r["size"] else 0)) < 1 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    return taken, want


def test_targets_and_words(spark):
    rows = drawn()
    small = mixture.taken(mixture.mixed(documents(spark, rows), leaf=50, bits=2)).collect()
    taken, want = check(rows, small)
    assert want["tiny"] < sum(len(t.split()) for _, t, s in rows if s == "b")
    check(rows, mixture.taken(mixture.mixed(documents(spark, rows))).collect())


def test_reruns_agree(spark):
    rows = drawn(800)
    runs = [Counter(map(tuple, mixture.taken(mixture.mixed(documents(spark, rows if k else rows[::-1]).repartition(1 + 4 * k), leaf=40, bits=2)).collect())) for k in range(2)]
    assert runs[0] == runs[1]
    other = Counter(map(tuple, mixture.taken(mixture.mixed(documents(spark, rows), seed=1, leaf=40, bits=2)).collect()))
    assert other != runs[0]


def test_each_document_keeps_its_expectation(spark):
    """Documents of one size, large or small, are copied target / source_size times in the mean."""
    sizes, seeds = [1, 2, 5, 30, 100], 6
    rows = [(100 * k + j, "w " * n, s) for s in "ab" for k, n in enumerate(sizes) for j in range(40)]
    docs = documents(spark, rows).coalesce(1).cache()
    total = Counter()
    for seed in range(seeds):
        for r in mixture.taken(mixture.mixed(docs, weights=(3, 7), seed=seed, leaf=64, bits=1)).collect():
            total[r["source"], r["size"]] += r["taken"] / r["size"]
    off = [(v / (40 * seeds) - {"a": 0.6, "b": 1.4}[s]) / np.sqrt(0.24 / (40 * seeds)) for (s, _), v in total.items()]
    assert len(off) == 10 and max(map(abs, off)) < 4


def test_rows_alike(spark):
    """A group of copies, larger than a chunk, is dealt as a whole; rows that share an id are told apart by their texts."""
    rows = [(7, "same text again", "a")] * 9000 + [(None, "no id", "a")] * 5 + [(7, "other text here", "a")] + [(k, "x " * k, "b") for k in range(50)]
    mix = mixture.mixed(documents(spark, rows)).cache()
    check(rows, mixture.taken(mix).collect())
    assert mix.where("source = 'a'").count() == 3
    copies = Counter((r["doc_id"], r["text"], r["source"]) for r in mixture.copied(documents(spark, rows), mix).collect())
    want = Counter()
    texts = {(s, i, " ".join((t or "").split())): t for i, t, s in rows}
    for r in mix.collect():
        found = [t for (s, i, _), t in texts.items() if s == r["source"] and i == r["doc_id"] and len(t.split()) == r["size"]]
        if len(found) == 1 and r["rows"] * r["copies"] + r["more"]:
            want[r["doc_id"], found[0], r["source"]] = r["rows"] * r["copies"] + r["more"]
    assert want and all(copies[k] == n for k, n in want.items()) and sum(copies.values()) == mix.selectExpr("sum(rows * copies + more)").first()[0]


def test_odd_rows(spark):
    rows = [(i, t, None if k % 3 else "s") for k, (i, t) in enumerate(odd_rows()) if "。" not in (t or "")]
    check(rows, mixture.taken(mixture.mixed(documents(spark, rows).selectExpr("*", "1 as size", "2 as rows", "3 as id", "4 as p", "5 as hash", "6 as rank"))).collect())
    for none in ([], [(1, None, "a"), (2, " \n", None)]):
        got = mixture.taken(mixture.mixed(documents(spark, none))).collect()
        assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * len(none)
    one = mixture.taken(mixture.mixed(documents(spark, [(1, "a b\x0bc d", "s")]))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in one] == [(3, 3.0, 3)]


def test_the_query(spark, sf_dir):
    found = queries.op13_mixture(spark, sf_dir)
    assert found.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    docs = {r["doc_id"]: r for r in queries.table(spark, sf_dir, "documents").collect()}
    import re

    sized = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = found.collect()
    want = Counter()
    for r in docs.values():
        want[r["source"]] += sized(r["text"])
    targets = target_of(want)
    taken = Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == sized(d["text"]) and r["source_size"] == want[d["source"]] and r["target"] == pytest.approx(targets[d["source"]], rel=1e-12)
        taken[d["source"]] += r["taken"]
    assert len(rows) == len(docs) and sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.02)
