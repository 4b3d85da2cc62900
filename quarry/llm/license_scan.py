"""License scans: a classifier of paragraphs, sparse word n-gram logistic regression, in SQL functions only.

Texts are cut into paragraphs at lines without a word and at line ends that end a sentence; signs of
comments in front of lines are no words, so a wrapped notice is one paragraph or a few. The features are the
n-grams, one to three words with a rare one among them, that some template has, as sparse vectors; an L1 penalty leaves few of them
a weight. A paragraph's logits are sums over its n-grams of weight; the unknown class is one of the
classes, and a temperature is calibrated on templates and paragraphs that were not learned from. A family
of enough probability must be confirmed: enough of a template's word triples must stand in the paragraph,
or enough of the paragraph's in a template. What is not confirmed is unknown.

No list of words decides what is scored: an n-gram of weight can only stand where its rarest word, by
counts over all paragraphs, does. A paragraph without any such word has the bias for its score, which is
that of the unknown class, and gives no row.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Different paragraphs of all documents that stand for the unknown class, about: those of low hashes.
MAX_UNKNOWN = 2000
#: Triples of templates all of whose words stand in more than this share of paragraphs are looked for as phrases, the others by their rarest word first: a matter of time alone.
COMMON_SHARE = 0.02
PROBABILITY = 0.6
TEMPLATE_SHARE = 0.4
#: Below this share of every template a paragraph is an example of the unknown class.
UNLIKE_SHARE = 0.2
UNKNOWN = "unknown"
#: Where paragraphs end: at lines without a letter or digit, and at a line's end that ends a sentence. It begins with the line's end, so other signs cost little.
BREAK = r"\n(?:(?:[^\p{L}\p{N}\n]*\n)+|(?<=[.:;!?][ \t]{0,8}\r?\n))"
#: What parts words.
PARTING = "[^a-z0-9]+"

# Notices by which texts state their licence, as commonly worded.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "This software is proprietary and confidential; unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
# Other wordings, on which the temperature is calibrated and from which nothing is learned.
OTHER_WORDINGS = {
    "apache-2.0": ["This code is under the Apache License 2.0."], "mit": ["This project is licensed under the MIT License."],
    "bsd": ["This module is distributed under the BSD 3-Clause License."], "gpl": ["This file is part of a program that is free software under the GNU General Public License, version 2."],
    "mpl-2.0": ["This file is available under the Mozilla Public License, version 2.0."], "cc": ["This page is licensed under a Creative Commons Attribution 4.0 International License."],
    "proprietary": ["Copyright 1999 Some Firm Ltd. All rights reserved."],
}
# Sentences that speak of such words without stating a licence.
UNLICENSED = [
    "the driver must show a license to the officer", "a fishing license is needed here", "he obtained permission to leave early", "the copyright debate went on for years",
    "she reserved all the seats and rights were read", "free software is a topic of this talk", "the public domain is large", "the license plate was lost", "they released a new version of the program",
    "under the terms of the agreement he left", "the general public was invited to the work", "the foundation published a list of free programs", "he asked for permission to use the source of the river",
    "apache helicopters flew over the valley", "the creative director shared her commons room", "conditions of any kind were met without warranty", "a copy of the file was included in the documentation",
    "the city licensed two new taxis", "human rights are reserved for no one", "the software was confidential for a year", "students at MIT wrote the program", "mozilla and gnu are names of projects", "you may use this file", "the author holds a driving licence, version of 1999",
]


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text, ws) of every paragraph with a word; a paragraph's words are in lower case."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.posexplode(F.split("text", BREAK)).alias("paragraph", "text"))
    return rows.withColumn("ws", F.split(F.lower("text"), PARTING))


def words(text: str) -> list[str]:
    """The words of a short text, as paragraphs() has them."""
    return [w for w in re.split(PARTING, text.lower()) if w]


def word_grams(ws: list[str]) -> list[str]:
    return [" ".join(ws[k : k + n]) for n in (1, 2, 3) for k in range(len(ws) - n + 1)]


def grams(ws: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct n-grams of an array of words, empty words left aside."""

    def at(ws: Column, n: int) -> Column:
        if n == 1:
            return ws
        each = F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(F.size(ws) >= n, each).otherwise(F.array().cast("array<string>"))

    ws = F.array_remove(ws, "")
    return F.array_distinct(F.concat(*[at(ws, n) for n in sizes]))


def strings(values) -> Column:
    return F.array(*[F.lit(x) for x in sorted(values)])


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column whose value is worked out once for each row, however often it is used later: it is made by a generator."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def triples(text: str) -> list[str]:
    """What templates are compared by: their word triples, or the whole of a shorter one."""
    ws = words(text)
    return sorted({" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)}) or [" ".join(ws)]


def template_triples() -> list[str]:
    return sorted({g for ts in TEMPLATES.values() for t in ts for g in triples(t)})


def template_share(family: str, found: Column) -> Column:
    """Over the family's templates the largest share of word triples that a paragraph and a template have in common, of the fewer of the two; found: grams()."""
    size = F.greatest(F.size(F.filter(found, lambda g: F.length(g) - F.length(F.replace(g, F.lit(" "))) == 2)), F.lit(1))
    each = [F.size(F.array_intersect(strings(own), found)) / F.least(F.lit(float(len(own))), size) for own in map(triples, TEMPLATES.get(family, ()))]
    return F.greatest(*each) if len(each) > 1 else each[0] if each else F.lit(0.0)


@dataclass
class LicenseModel:
    families: list[str]  # the unknown class is one of them
    vocabulary: list[str]  # n-grams of weight
    weights: list[list[float]]  # of each family, by n-gram
    bias: list[float]
    temperature: float
    cues: list[str]  # the rarest word of each triple of a template, if that is rare
    phrases: list[str]  # the other triples; without any cue or phrase no template can confirm


def word_shares(docs: DataFrame) -> dict[str, float]:
    """Of each word of the templates, the share of all documents' paragraphs that it stands in."""
    own = sorted({w for ts in TEMPLATES.values() for t in ts for w in words(t)})
    found = F.explode(F.concat(F.array(F.lit("")), F.array_intersect("ws", strings(own)))).alias("w")  # the empty word counts paragraphs
    counts = {r["w"]: r["n"] for r in paragraphs(docs).select(found).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(counts.get("", 0), 1)
    return {w: counts.get(w, 0) / total for w in own} | {"": float(total)}


def unlike_templates(docs: DataFrame, shares: dict[str, float], most: int = MAX_UNKNOWN) -> DataFrame:
    """(text, ws) of different paragraphs that hold a word of templates but are like none: as many as `most`, about, by their hashes."""
    own = [w for w in shares if w]
    bound = shares[""] * min(1.0, sum(shares[w] for w in own))  # no more paragraphs than this hold one
    rows = paragraphs(docs).where(F.arrays_overlap("ws", strings(own)))
    if bound > most:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * most / bound))
    rows = stored(rows.dropDuplicates(["text"]).withColumn("at", grams(F.col("ws"))))  # written, so that each row's n-grams are made once
    return rows.where(F.greatest(*[template_share(f, F.col("at")) for f in TEMPLATES]) < UNLIKE_SHARE).select("text", "ws")


def _examples(families: list[str]) -> list[tuple[int, list[str], bool]]:
    """(class, words, held out): templates, their halves, and the sentences without a licence, among other words."""
    out = []
    for k, family in enumerate(families):
        for text in UNLICENSED if family == UNKNOWN else TEMPLATES[family]:
            ws = words(text)
            parts = [ws] if family == UNKNOWN or len(ws) < 20 else [ws, ws[: len(ws) // 2], ws[len(ws) // 2 :], ws[len(ws) // 4 : 3 * len(ws) // 4]]
            out += [(k, words(around % " ".join(p)), False) for p in parts for around in ("%s", "this file %s thank you", "see also %s", "%s of the and", "notice %s")]
        out += [(k, words(text), True) for text in OTHER_WORDINGS.get(family, ())]
    return out


def learn_licenses(docs: DataFrame, most_unknown: int = MAX_UNKNOWN) -> LicenseModel:
    """Fit on examples from the templates and on paragraphs of docs that are like none of them; a sixth of the latter calibrates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark = docs.sparkSession
    families = [UNKNOWN, *TEMPLATES]
    shares = word_shares(docs)
    known = spark.createDataFrame(_examples(families), "label int, ws array<string>, held boolean")
    lines = unlike_templates(docs, shares, most_unknown)
    rows = known.union(lines.select(F.lit(0), "ws", F.pmod(F.xxhash64("text"), F.lit(6)) == 0))
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in word_grams(words(t))})
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "at", "features")
    rows = stored(rows.select("label", "held", F.array_intersect(grams(F.col("ws")), strings(vocabulary)).alias("at")))
    rows = vectors.transform(rows).coalesce(4)
    model = LogisticRegression(maxIter=100, regParam=1e-3, elasticNetParam=0.5, family="multinomial", standardization=False).fit(rows.where("not held"))
    logits = model.transform(rows.where("held")).select("label", "rawPrediction").collect()

    def loss(t: float) -> float:
        total = 0.0
        for r in logits:
            z = [x / t for x in r["rawPrediction"]]
            top = max(z)
            total += top + math.log(sum(math.exp(x - top) for x in z)) - z[r["label"]]
        return total

    temperature = min((0.1, 0.18, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    weights = model.coefficientMatrix.toArray().round(6)
    some = [k for k in range(len(vocabulary)) if weights[:, k].any()]
    rarest = {g: min(g.split(), key=lambda w: (shares.get(w, 0.0), w)) for g in template_triples()}
    phrases = [g for g, w in rarest.items() if shares.get(w, 0.0) > COMMON_SHARE]
    cues = sorted({w for g, w in rarest.items() if g not in phrases})
    return LicenseModel(families, [vocabulary[k] for k in some], weights[:, some].tolist(), model.interceptVector.toArray().tolist(), temperature, cues, phrases)


def scan_licenses(docs: DataFrame, model: LicenseModel, probability: float = PROBABILITY, share: float = TEMPLATE_SHARE) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_share, confirmed, text) of every paragraph that has an n-gram of weight and, with some template, a word triple (or all of a shorter one) in common.

    docs: doc_id long, text string; other columns don't matter. paragraph counts the text's paragraphs
    from 0. family is "unknown" where that is the likeliest, where the probability is too low or no
    template confirms. Null and empty texts, and paragraphs without such n-grams, give no rows;
    repeated rows of docs give rows each.
    """
    vocabulary, kept = strings(model.vocabulary), ["doc_id", "paragraph", "text"]
    may = F.arrays_overlap("ws", strings(model.cues)) if model.cues else F.lit(False)
    if model.phrases:
        line = F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))
        may = may | F.exists(F.array(line), lambda x: reduce(or_, [F.contains(x, F.lit(f" {g} ")) for g in model.phrases]))
    rows = once(paragraphs(docs).where(may).select(*kept, "ws"), "at", grams(F.col("ws")))
    rows = rows.where(F.arrays_overlap("at", strings(template_triples())))  # no other can be confirmed
    rows = once(rows.drop("ws"), "hits", F.array_intersect("at", vocabulary)).where(F.size("hits") > 0)
    rows = once(rows, "places", F.transform("hits", lambda g: F.array_position(vocabulary, g).cast("int") - 1))

    def logit(weights: list[float], bias: float) -> Column:
        return F.aggregate("places", F.lit(float(bias)), lambda s, i: s + F.get(F.array(*[F.lit(x) for x in weights]), i)) / model.temperature

    rows = once(rows, "z", F.array(*[logit(w, b) for w, b in zip(model.weights, model.bias)]))
    rows = once(rows, "top", F.array_max("z"))
    rows = rows.withColumn("p", 1 / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    names = F.array(*[F.lit(x) for x in model.families])
    rows = once(rows, "guess", F.element_at(names, F.array_position("z", F.col("top")).cast("int")))
    of_guess = F.lit(0.0)
    for family in TEMPLATES:
        of_guess = F.when(F.col("guess") == family, template_share(family, F.col("at"))).otherwise(of_guess)
    rows = once(rows, "share", of_guess)
    sure = (F.col("guess") != UNKNOWN) & (F.col("p") >= probability) & (F.col("share") >= share)
    return rows.select("doc_id", "paragraph", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), F.col("p").alias("probability"), F.col("share").alias("template_share"), sure.alias("confirmed"), "text")


def license_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan_licenses(docs, learn_licenses(docs))
