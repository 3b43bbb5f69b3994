"""Licence scans: a trained paragraph classifier.

Paragraphs are lines, and runs of two or more lines that aren't blank: a notice may stand on a line
of its own or be wrapped over several. Features are a paragraph's distinct words and word pairs
(lower case, letters and digits only). A sparse multinomial logistic regression (elastic net) over
them tells licence families and an `unknown` class apart. It is trained here, on the notices below,
on parts of them, and on at most SAMPLE_PARAGRAPHS unlabelled paragraphs of SAMPLE_DOCS documents as
`unknown`. The least probability of a family that counts is calibrated on at most
CALIBRATION_PARAGRAPHS others of them, held out of training, so that at most one in a thousand of
the unknown ones passes. A prediction is confirmed by comparison with the family's templates: the
part of a template's word pairs that the paragraph has.

A run of lines counts only if it is confirmed and none of its lines is so by itself for that family;
it then stands for the lines in it.

A paragraph that has none of the words without which the model's weights can't lift a family above
`unknown` needs no scoring. For the others, features meet the model's table (at most MAX_TERMS rows,
so broadcast) and sums by paragraph give the class scores. Paragraphs without any feature of the
model, and those below the calibrated probability, are unknown and not returned.

Edge cases: null and empty texts have no paragraphs; repeated rows are scored each; a null doc_id
is carried; an empty table trains on the notices alone and gives an empty result; extra columns
are ignored; a text is scanned whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, sampled, stored

SAMPLE_PARAGRAPHS, CALIBRATION_PARAGRAPHS, SAMPLE_DOCS, MAX_TERMS = 1500, 20_000, 2000, 4096
CONFIRMED = 0.6
UNKNOWN = "unknown"

#: Notices by family: fixed values, as their licences word them.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "Released under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}
#: Sentences about licences that grant none.
NEAR_MISSES = (
    "The driver lost his licence after the accident and was released under bail.",
    "Version 3 of the report is available to the general public at the library.",
    "The software was modified by a person who had obtained a copy of the documentation.",
    "The apache helicopter was used without restriction in the following year.",
    "The terms of the agreement between the university and MIT were published in 2004.",
    "He was granted permission to work under the conditions of the foundation.",
    "A creative person needs attribution and common sense, said the international jury.",
    "The binary star was distributed over four catalogues, version 2.0 of which is public.",
)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def paragraphs(text: Column) -> Column:
    """Array of (paragraph, n_lines, line): each line, and each run of several lines that aren't blank;
    paragraph counts lines from 0."""
    as_struct = lambda at, n, line: F.struct(at.cast("int").alias("paragraph"), n.cast("int").alias("n_lines"), line.alias("line"))
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def runs(lines: Column, full: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(lines) - 1)
        there = lambda i: F.coalesce(F.get(full, i), F.lit(False))
        firsts = F.filter(places, lambda i: F.get(full, i) & ~there(i - 1) & there(i + 1))
        lasts = F.filter(places, lambda i: F.get(full, i) & there(i - 1) & ~there(i + 1))
        return F.zip_with(firsts, lasts, lambda a, b: as_struct(a, b - a + 1, F.array_join(F.slice(lines, a + 1, b - a + 1), " ")))

    def both(lines: Column) -> Column:
        full = F.transform(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.concat(F.transform(lines, lambda x, i: as_struct(i, F.lit(1), x)), bind(full, lambda f: runs(lines, f)))

    return bind(lines_of(text), both)


def tokens(paragraph: Column) -> Column:
    return F.filter(F.split(ascii_lower(paragraph), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def features(words: Column) -> Column:
    """Hashes of the distinct words and word pairs."""
    ones = F.transform(words, lambda w: F.xxhash64(w))
    last = F.greatest(F.size(words) - 1, F.lit(0))
    twos = F.zip_with(F.slice(words, 1, last), F.slice(words, 2, last), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(F.concat(ones, twos))


def terms(words: Column) -> Column:
    return F.array_distinct(F.concat(words, F.transform(pairs(words), lambda p: F.concat_ws(" ", p["a"], p["b"]))))


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    weights: dict[str, tuple[float, ...]]  # of each term, a weight a family
    bias: tuple[float, ...]
    least: float  # probability from which a family counts
    screen: tuple[str, ...] = ()  # a paragraph of a family has one of these words


def screen_words(weights: dict[str, tuple[float, ...]], bias: tuple[float, ...], common: dict[str, int]) -> tuple[str, ...]:
    """Words of which a paragraph needs one to beat the unknown class, by the model's own weights.

    Terms that speak for a family are left out, the commonest in the sample first, as long as all of
    those left out can't together lift any family above unknown. What remains is needed.
    """
    gain = {t: max(x - w[-1] for x in w[:-1]) for t, w in weights.items()}
    speak = sorted((t for t in gain if gain[t] > 0), key=lambda t: -min(common.get(x, 0) for x in t.split(" ")))
    lift, need = max(b - bias[-1] for b in bias[:-1]), set()
    for t in speak:
        if lift + gain[t] < 0:
            lift += gain[t]
        else:
            need.add(min(t.split(" "), key=lambda x: common.get(x, 0)))
    return tuple(sorted(need))


def _examples(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(label, part, paragraph). Halves and thirds of notices teach what wrapped lines look like."""
    rows = []
    for k, (family, notices) in enumerate(TEMPLATES.items()):
        for notice in notices:
            w = notice.split()
            cuts = [w, w[: max(5, 2 * len(w) // 3)], w[-max(5, 2 * len(w) // 3) :]]
            if len(w) > 16:
                cuts += [w[: len(w) // 2], w[len(w) // 2 :]]
            rows += [(float(k), 0, " ".join(c)) for c in cuts] * 4
            rows.append((float(k), 0, "Copyright 2020 the authors. " + notice))
    other = float(len(TEMPLATES))
    rows += [(other, 0, x) for x in NEAR_MISSES] * 4
    sample = sampled(docs, SAMPLE_DOCS).select(F.explode(lines_of(F.col("text"))).alias("paragraph")).distinct()
    # unlabelled paragraphs may hold a notice: those with most of a template's pairs are left out
    known = [F.lit([f"{a} {b}" for a, b in sorted(_pairs_in(n))]) for ns in TEMPLATES.values() for n in ns if _pairs_in(n)]
    own = F.transform(pairs(tokens(F.col("paragraph"))), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    like = F.element_at(F.transform(F.array(own), lambda x: reduce(lambda a, b: a | b, [F.size(F.array_intersect(t, x)) >= 0.4 * F.size(t) for t in known])), 1)
    by_hash = F.xxhash64("paragraph")
    sample = sample.orderBy(by_hash, "paragraph").limit(SAMPLE_PARAGRAPHS + CALIBRATION_PARAGRAPHS).filter(~like)
    # the least hashes, up to the bound, train; the others calibrate
    sample = sample.withColumn("part", F.when(F.row_number().over(Window.orderBy(by_hash, "paragraph")) <= SAMPLE_PARAGRAPHS, 0).otherwise(1))
    sample = sample.select(F.lit(other).alias("label"), "part", "paragraph")
    return spark.createDataFrame(rows, "label double, part int, paragraph string").unionByName(sample)


def train(spark: SparkSession, docs: DataFrame) -> Model:
    data = stored(spark, _examples(spark, docs).withColumn("terms", terms(tokens(F.col("paragraph")))), "licence-examples")
    counts = CountVectorizer(inputCol="terms", outputCol="x", binary=True, vocabSize=MAX_TERMS, minDF=2).fit(data.filter("part = 0"))
    at = counts.transform(data)
    fit = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=80).fit(at.filter("part = 0"))
    coefficients = fit.coefficientMatrix.toArray().T.tolist()
    weights = {t: tuple(c) for t, c in zip(counts.vocabulary, coefficients, strict=True) if any(abs(x) > 1e-6 for x in c)}
    families = (*TEMPLATES, UNKNOWN)
    bias = tuple(fit.interceptVector.toArray().tolist())
    spoken = data.filter((F.col("label") == len(TEMPLATES)) & (F.col("part") == 0)).select(F.explode(F.array_distinct(tokens(F.col("paragraph")))).alias("w"))
    screen = screen_words(weights, bias, dict(spoken.groupBy("w").count().filter(F.col("w").isin(sorted({x for t in weights for x in t.split(" ")}))).collect()))
    model = Model(families, weights, bias, 0.0, screen)
    # held-out unknown paragraphs set the least probability, on top of one half
    held = at.filter("part = 1").select(F.monotonically_increasing_id().alias("doc_id"), F.col("paragraph").alias("text"))
    passing = held.count() // 1000
    p = [r[0] for r in scored(spark, held, model).orderBy(F.desc("probability")).select("probability").limit(passing + 1).collect()]
    return Model(families, weights, bias, max(0.5, p[passing] * (1 + 1e-9)) if len(p) > passing else 0.5, screen)


def _table(spark: SparkSession, model: Model) -> DataFrame:
    """h, a weight a class, and for each family whether its templates have the pair."""
    of = {}
    for k, notices in enumerate(TEMPLATES.values()):
        for j, notice in enumerate(notices):
            of.setdefault((k, j), notice)
    notices = spark.createDataFrame([(k, j, n) for (k, j), n in of.items()], "k int, j int, n string")
    has = notices.select("k", "j", F.explode(F.array_distinct(F.transform(pairs(tokens(F.col("n"))), lambda p: F.xxhash64(p["a"], p["b"])))).alias("h"))
    has = has.groupBy("h").agg(F.collect_list(F.struct("k", "j")).alias("of"))
    rows = [(t.split(" ")[0], (t.split(" ") + [None])[1], [float(x) for x in w]) for t, w in model.weights.items()]
    table = spark.createDataFrame(rows, "a string, b string, w array<double>")
    table = table.select(F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")).alias("h"), "w")
    zero = F.array(*[F.lit(0.0)] * len(model.families))
    return table.join(has, "h", "full").select("h", F.coalesce("w", zero).alias("w"), F.coalesce("of", F.array().cast("array<struct<k:int,j:int>>")).alias("of"))


def scored(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, paragraph, n_lines, family, probability, similarity, confirmed) of the paragraphs that
    are of a family with at least the model's least probability."""
    n = len(model.families)
    table = stored(spark, _table(spark, model), "licence-model")
    marks = [F.array_contains("of", F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"))).cast("int").alias(f"t{k}_{j}") for k, ns in enumerate(TEMPLATES.values()) for j in range(len(ns))]
    flat = table.select("h", *[F.get("w", F.lit(k)).alias(f"w{k}") for k in range(n)], *marks)
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), paragraphs(F.col("text")).alias("of"))
    lines = lines.select("row", "doc_id", F.inline("of"))
    lines = lines.withColumn("words", tokens(F.col("line"))).filter(F.arrays_overlap("words", F.lit(list(model.screen))))
    found = lines.select("row", "doc_id", "paragraph", "n_lines", F.explode(features(F.col("words"))).alias("h")).join(F.broadcast(flat), "h")
    sums = found.groupBy("row", "doc_id", "paragraph", "n_lines").agg(*[F.sum(c).alias(c) for c in flat.columns[1:]])
    logits = F.array(*[F.col(f"w{k}") + F.lit(model.bias[k]) for k in range(n)])
    sizes = {(k, j): len(_pairs_in(notice)) for k, ns in enumerate(TEMPLATES.values()) for j, notice in enumerate(ns)}
    alike = F.array(*[F.greatest(*[F.col(f"t{k}_{j}") / F.lit(float(sizes[k, j])) for j in range(len(ns))], F.lit(0.0)) for k, ns in enumerate(TEMPLATES.values())])
    out = sums.withColumns({"_z": logits, "_alike": alike}).withColumn("_max", F.array_max("_z"))
    out = out.withColumn("_best", (F.array_position("_z", F.col("_max")) - 1).cast("int")).filter(F.col("_best") < n - 1)
    total = F.aggregate("_z", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("_max")))
    out = out.withColumns({"probability": 1 / total, "family": F.get(F.array(*[F.lit(x) for x in model.families]), F.col("_best")), "similarity": F.get("_alike", F.col("_best"))})
    out = out.filter(F.col("probability") >= model.least)
    return out.select("row", "doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("n_lines").cast("long").alias("n_lines"), "family", "probability", "similarity", (F.col("similarity") >= CONFIRMED).alias("confirmed"))


def classify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph, n_lines, family, probability, similarity, confirmed) of the licence paragraphs.
    paragraph is the number of its first line, from 0."""
    found = stored(spark, scored(spark, docs, model), "licences")
    line, run = found.filter("n_lines = 1").alias("line"), found.filter("n_lines > 1 AND confirmed").alias("run")
    inside = "line.row = run.row AND line.paragraph >= run.paragraph AND line.paragraph < run.paragraph + run.n_lines"
    run = run.join(line, F.expr(f"{inside} AND line.confirmed AND line.family = run.family"), "left_anti").alias("run")
    return line.join(run, F.expr(inside), "left_anti").unionByName(run).drop("row")


def _pairs_in(notice: str) -> set[tuple[str, str]]:
    """Word pairs of a notice, split as tokens() does."""
    words = "".join(c if c.isalnum() else " " for c in notice.lower()).split()
    return set(zip(words, words[1:], strict=False))


def scan(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Licence paragraphs of all documents, by a model trained here unless one is given."""
    return classify(spark, docs, model or train(spark, docs))
