"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A multinomial logistic regression over words and word pairs tells the licence families apart from any other
paragraph.  It is trained here, on variants of the notices below, also amidst other words, and on a bounded sample of the
corpus' own paragraphs as the unknown class, by proximal gradient steps that are joins and aggregations; the L1 term leaves
few weights.  Half of the variants and of the sample are kept from training and set, for each family, the probability
from which it is believed: few unknown paragraphs reach it and most of the family's do.  A prediction is then
confirmed by comparing the paragraph's word pairs with those of the family's notices.

A paragraph is a line, or the neighbourhood of a line break: what is around it up to the next empty lines, as
many words to either side as the longest notice has.  So a notice is whole in one of them however it is wrapped.  Lines of
more than twice as many words are cut into overlapping pieces of that size, so a notice is whole in one of these too.

To be confirmed, a paragraph needs a share of a notice's pairs, so it has at least one of any set of them that is larger
than the rest.  Such a set is chosen for each notice, its rarest pairs by the words in them; only documents and
paragraphs with one of these pairs are scored, and nothing is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import delete, written

# Wordings in which works name their licence.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Distributed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd-3-clause": [
        "Released under the 3-clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content is available under CC BY 4.0.",
    ],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without permission. All rights reserved."],
}
#: What is written around notices, to make variants.
BEFORE = ["", "Copyright (c) 2019 Jane Doe.", "Copyright 2011-2024 The Authors and contributors", "NOTE:", "This file is part of the project."]
AFTER = ["", "See the LICENSE file for details.", "Version 1.2 of 2020"]
# English words that are too common to tell a notice by.
COMMON = frozenset("a an and any are as at be by can following for from if in is it its may not of on or other that the these this to under use used was which with you".split())
UNKNOWN = "unknown"
CLASSES = [*NOTICES, UNKNOWN]
#: Paragraphs of the corpus that stand for the unknown class, half of them to train.
SAMPLE = 3000
STEPS, RATE, L1 = 10, 2.0, 2e-4
#: Share of a notice's word pairs, or words, that a confirmed paragraph has.
CONFIRMED = 0.6
#: Shares of held-out unknown paragraphs below a family's probability, and of its own variants above it; if both cannot be, the second counts.
QUIET, FOUND = 0.999, 0.95
BIAS = ""


def _split(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


#: Words of the longest notice.
LONGEST = max(len(_split(text)) for texts in NOTICES.values() for text in texts)


def telling_pairs() -> list[str]:
    """Word pairs of which each paragraph that can be confirmed has one."""
    out: set[str] = set()
    for texts in NOTICES.values():
        for own in map(_split, texts):
            both = sorted({f"{a} {b}" for a, b in zip(own, own[1:])} or set(own))
            both.sort(key=lambda p: (sum(w in COMMON for w in p.split()), -len(p)))
            needed = math.ceil(CONFIRMED * len(both) - 1e-9)
            out.update(both[: len(both) - needed + 1])
    return sorted(out)


def may_have(text: Column) -> Column:
    """Whether a text has one of the telling pairs, however they are parted."""
    by_first: dict[str, list[str]] = {}
    for pair in telling_pairs():
        by_first.setdefault(pair[0], []).append(r"[^\p{L}\p{N}]+".join(map(re.escape, pair[1:].split(" "))))
    return F.lower(text).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(by_first.items())) + r")(?![\p{L}\p{N}])")


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, also where f uses it for each element of an array."""
    return F.element_at(F.transform(F.array(x), f), 1)


def pairs(w: Column) -> Column:
    """Word pairs; of a single word, the word."""
    return bound(w, lambda w: F.when(F.size(w) < 2, w).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))))


def ngrams(w: Column) -> Column:
    """The features of a paragraph: its distinct words and word pairs, and the bias."""
    return bound(w, lambda w: F.array_union(F.array(F.lit(BIAS)), F.array_union(w, pairs(w))))


def paragraphs(documents: DataFrame, wrapped: bool = True) -> DataFrame:
    """doc_id, pos (first and last line, from 0) and w, the words, of each line, in pieces if it is long, and, if wrapped, around each line break between lines with words."""
    found = documents.where("text is not null").select("doc_id", F.transform(F.split(F.col("text").cast("string"), "\n"), words).alias("_lines"))
    place = lambda i, last: F.struct(i.cast("int").alias("first"), last.cast("int").alias("last"))

    def pieces(w: Column, i: Column) -> Column:
        starts = F.when(F.size(w) <= 2 * LONGEST, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(w) - LONGEST - 1, F.lit(LONGEST)))
        return F.transform(starts, lambda a: F.struct(place(i, i).alias("pos"), F.slice(w, a + 1, 2 * LONGEST).alias("w")))

    out = F.flatten(F.transform("_lines", pieces))
    if wrapped:
        start = F.struct(F.array().cast("array<string>").alias("w"), F.lit(0).alias("n"), F.lit(False).alias("over"))

        def more(acc: Column, w: Column) -> Column:
            over = acc["over"] | (F.size(w) == 0) | (F.size(acc["w"]) >= LONGEST)
            return F.when(over, F.struct(acc["w"].alias("w"), acc["n"].alias("n"), F.lit(True).alias("over"))).otherwise(F.struct(F.concat(acc["w"], F.slice(w, 1, LONGEST)).alias("w"), (acc["n"] + 1).alias("n"), F.lit(False).alias("over")))

        def around(w: Column, i: Column) -> Column:
            after = F.aggregate(F.slice("_lines", i + 2, LONGEST), start, more)
            both = bound(after, lambda x: F.struct(place(i, i + x["n"]).alias("pos"), F.concat(F.slice(w, F.greatest(F.lit(1), F.size(w) - LONGEST + 1), LONGEST), x["w"]).alias("w")))
            return F.when((F.size(w) > 0) & (F.size(F.get("_lines", i + 1)) > 0), both)

        out = F.concat(out, F.filter(F.transform("_lines", around), lambda x: x.isNotNull()))
    return found.select("doc_id", F.explode(out).alias("_p")).select("doc_id", "_p.pos", "_p.w")


def features(rows: DataFrame, *keys: str) -> DataFrame:
    """A row per feature; all features of a paragraph weigh alike, and less the more there are."""
    one = rows.withColumn("_n", ngrams(F.col("w"))).select(*keys, (1 / F.sqrt(F.size("_n"))).alias("_x"), F.explode("_n").alias("feature"))
    return one.select(*keys, "feature", F.when(F.col("feature") == BIAS, F.lit(1.0)).otherwise(F.col("_x")).alias("x"))


def _probabilities(logits: DataFrame) -> DataFrame:
    """Adds p, the probabilities of the classes as an array, to rows of logits w0, w1, ..."""
    out = logits.withColumn("_l", F.array(*(f"w{k}" for k in range(len(CLASSES)))))
    out = out.withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    return out.withColumn("p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y))).drop("_l", "_e")


def notices(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in NOTICES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string").select("family", words(F.col("text")).alias("w"))


def variants(spark: SparkSession) -> DataFrame:
    """family and words w of each notice with what may be written around it."""
    rows = [(family, f"{before} {text} {after}") for family, texts in NOTICES.items() for text in texts for before in BEFORE for after in AFTER]
    return spark.createDataFrame(rows, "family string, text string").select("family", words(F.col("text")).alias("w"))


def train(documents: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[str, float]]:
    """(feature and a weight for each class, w0, w1, ...; the probability from which each family is believed)

    sample bounds how many paragraphs of the corpus are taken, those with the smallest hashes of a share of the documents.
    """
    spark = documents.sparkSession
    n = len(CLASSES)
    total = max(1, documents.count())
    share = min(1.0, sample / total)
    drawn = F.pmod(F.xxhash64("doc_id", "pos", "w"), F.lit(1_000_000_007))
    some = paragraphs(documents.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003) < share), wrapped=False).where(F.size("w") > 0)
    some = written(some.orderBy(drawn, "doc_id", "pos", "w").limit(sample).withColumn("_pairs", pairs(F.col("w"))), "drawn")
    # lines that a notice's wording already confirms, or that are pieces of a notice, are no examples of other paragraphs
    wordings = [r[0] for r in notices(spark).select(F.array_distinct(pairs(F.col("w")))).collect()]
    some = some.where(~F.exists(F.array(*(F.array(*map(F.lit, x)) for x in wordings)), lambda x: F.size(F.array_intersect(x, "_pairs")) >= CONFIRMED * F.least(F.size(x), F.size("_pairs"))))
    unknown = some.select(F.lit(n - 1).alias("y"), "w", (drawn % 2 == 0).alias("held"))
    code = F.coalesce(*(F.when(F.col("family") == c, k) for k, c in enumerate(CLASSES)))
    named = [(k, family, text) for k, (family, text) in enumerate((f, t) for f, texts in NOTICES.items() for t in texts)]
    table = spark.createDataFrame(named, "notice int, family string, own string").select("notice", "family", words(F.col("own")).alias("own"))
    half = (F.size("w") / 2).cast("int")
    inside = some.where(F.pmod(F.xxhash64("w", F.lit("inside")), F.lit(4)) == 0).withColumn("notice", F.pmod(F.xxhash64("w"), F.lit(len(named))).cast("int")).join(F.broadcast(table), "notice")
    inside = inside.select("family", F.concat(F.slice("w", F.greatest(F.lit(1), half - LONGEST + 1), F.least(half, F.lit(LONGEST))), "own", F.slice("w", half + 1, LONGEST)).alias("w"))
    known = variants(spark).unionByName(inside).select(code.alias("y"), "w", (F.pmod(F.xxhash64("w"), F.lit(2)) == 0).alias("held"))
    rows = written(unknown.unionByName(known).withColumn("row", F.monotonically_increasing_id()), "paragraphs")
    size = rows.where("not held").groupBy("y").agg(F.count("*").alias("members"))
    weight = F.when(F.col("y") == n - 1, 1.0).otherwise(1.0 / (n - 1)) / F.col("members")
    used = written(features(rows.where("not held").join(F.broadcast(size), "y").withColumn("weight", weight), "row", "y", "weight"), "features")
    w, g = [f"w{k}" for k in range(n)], [f"g{k}" for k in range(n)]
    model = written(used.select("feature").distinct().select("feature", *(F.lit(0.0).alias(c) for c in w + g)), "model")
    for _ in range(STEPS):
        logits = used.join(model, "feature").groupBy("row", "y", "weight").agg(*(F.sum(F.col("x") * F.col(c)).alias(c) for c in w))
        off = _probabilities(logits).select("row", *(((F.get("p", F.lit(k)) - (F.col("y") == k).cast("double")) * F.col("weight")).alias(f"d{k}") for k in range(n)))
        step = used.join(F.broadcast(off), "row").groupBy("feature").agg(*(F.sum(F.col("x") * F.col(f"d{k}")).alias(f"s{k}") for k in range(n)))
        new = model.join(step, "feature")
        grown = [F.col(f"g{k}") + F.col(f"s{k}") * F.col(f"s{k}") for k in range(n)]
        rate = [RATE / (F.sqrt(x) + 1e-4) for x in grown]
        moved = [F.col(f"w{k}") - rate[k] * F.col(f"s{k}") for k in range(n)]
        shrunk = [F.when(F.col("feature") == BIAS, m).otherwise(F.signum(m) * F.greatest(F.abs(m) - rate[k] * L1, F.lit(0.0))) for k, m in enumerate(moved)]
        before, model = model, written(new.select("feature", *(x.alias(c) for x, c in zip(shrunk, w, strict=True)), *(x.alias(c) for x, c in zip(grown, g, strict=True))), "model")
        delete(before)
    model = written(model.where(F.greatest(*(F.abs(c) for c in w)) > 0).select("feature", *w), "model")
    named = F.get(F.array(*map(F.lit, CLASSES)), F.col("y"))
    held = scored(rows.where("held").withColumn("named", named), model, "row", "named")
    held = held.select("named", "family", F.when((F.col("named") == UNKNOWN) | (F.col("named") == F.col("family")), F.col("p")).otherwise(0.0).alias("p"))
    quiet = {r[0]: r[1] for r in held.where(F.col("named") == UNKNOWN).groupBy("family").agg(F.percentile_approx("p", QUIET, 10_000)).collect()}
    found = {r[0]: r[1] for r in held.where(F.col("named") != UNKNOWN).groupBy("named").agg(F.percentile_approx("p", 1 - FOUND, 10_000)).collect()}
    return model, {f: min(max(0.5, quiet.get(f, 0.0)), found.get(f, 1.0)) for f in NOTICES}


def scored(found: DataFrame, model: DataFrame, *keys: str) -> DataFrame:
    """The keys of the paragraphs, family (the most likely one, the first of equal ones) and its probability p."""
    n = len(CLASSES)
    sums = features(found, *keys).join(model, "feature").groupBy(*keys).agg(*(F.sum(F.col("x") * F.col(f"w{k}")).alias(f"w{k}") for k in range(n)))
    named = F.slice("p", 1, n - 1)
    best = _probabilities(sums).withColumn("best", F.array_max(named))
    return best.select(*keys, F.get(F.array(*map(F.lit, CLASSES)), (F.array_position(named, F.col("best")) - 1).cast("int")).alias("family"), F.col("best").alias("p"))


def licences(documents: DataFrame, model: DataFrame, believed: dict[str, float]) -> DataFrame:
    """doc_id, pos, family, p and share of the paragraphs whose family is believed and confirmed; paragraphs of rows that repeat a doc_id stay apart."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = paragraphs(docs.where(may_have(F.col("text")))).where(F.arrays_overlap(pairs(F.col("w")), F.array(*map(F.lit, telling_pairs()))))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "telling")
    enough = F.coalesce(*(F.when(F.col("family") == f, F.lit(p)) for f, p in believed.items()))
    found = scored(rows, F.broadcast(model), "row").where(F.col("p") >= enough)
    known = notices(documents.sparkSession).select("family", F.array_distinct(pairs(F.col("w"))).alias("notice"))
    both = rows.join(found, "row").join(F.broadcast(known), "family")
    share = F.size(F.array_intersect("notice", pairs(F.col("w")))) / F.size("notice")
    both = both.select("row", "doc_id", "pos", "family", "p", share.alias("share")).where(F.col("share") >= CONFIRMED)
    return both.groupBy("row", "doc_id", "pos", "family", "p").agg(F.max("share").alias("share")).drop("row")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_found (confirmed paragraphs; of a family, those that share a line count once), families (sorted, joined by commas; empty: none) and p (the highest), per doc_id.

    A null or empty text has no paragraphs.  Rows that repeat a doc_id count as one document; a null doc_id is
    one too.  Without documents the result is empty.
    """
    model, believed = train(documents)
    found = licences(documents, model, believed)
    reached = F.max("pos.last").over(Window.partitionBy("doc_id", "family").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_new", F.coalesce(F.col("pos.first") > reached, F.lit(True)))
    found = found.groupBy("doc_id").agg(F.count_if("_new").alias("n_found"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("p").alias("p"))
    ids = documents.select("doc_id").distinct().withColumnRenamed("doc_id", "_id")
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("doc_id")), "left")
    return out.select(F.col("_id").alias("doc_id"), F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("p", F.lit(0.0)).alias("p"))
