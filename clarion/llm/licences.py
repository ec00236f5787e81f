"""Licence scan: a trained paragraph classifier whose finds templates confirm.

Every line of every text is a paragraph.  Its word 1- and 2-grams feed a sparse
(L1) multinomial logistic regression over the licence families and an unknown
class.  It is trained on word windows of the templates below and on a bounded
sample of ``UNKNOWN_ROWS`` paragraphs of the corpus (the smallest hashes) that
resemble no template.  A quarter of the training rows is held back to calibrate
the probabilities: the temperature with the least loss on them is used.  A
predicted family stands if its calibrated probability is at least
``LEAST_PROBABILITY`` and a template of the family confirms it: of the word
pairs of the shorter one, ``LEAST_SHARED`` are shared, ``LEAST_PAIRS`` of them at least.

The vocabulary consists of all word pairs of the templates, however common their
words are, and of the templates' words that are rare in the sample.  A paragraph
with none of them has no features at all, is scored by the intercepts alone, and
is unknown; so only the others are turned into vectors, without changing any
result.

Null and empty texts have no paragraphs; every document gets a row, and rows
that repeat a doc_id the same one (paragraphs of all of them together).  With
no documents there are no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clarion.llm.common import stored

#: Notices of well-known licences, by family.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "Released under the GNU GPL version 2.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
#: Sentences with licence words that are no notices.
OTHERS = [
    "The driver renewed a license at the office last week.", "A fishing license is required at the lake.", "The version of the file was released last year.",
    "They reserved a table and all rights of way were closed.", "Free software was the topic of the public talk.", "The general public may see the work at the museum.",
    "Permission to enter was granted to the person.", "The source of the river is in the north.", "An apache helicopter was seen.", "He modified the terms of the agreement.",
]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *sorted(TEMPLATES)]
UNKNOWN_ROWS, WINDOW_WORDS, COMMON = 4_000, (6, 12, 24), 0.002
LEAST_PROBABILITY, LEAST_SHARED = 0.5, 0.6
#: Pairs that a confirmed line shares with its template at least, where that has so many.
LEAST_PAIRS = 3
ITERATIONS, L1 = 40, 0.0005
TEMPERATURES = (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0)


def words_of(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"""[\s,;:()"']+|\.(?=\s|$)"""), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` plus a column that is computed once per row.

    A generator's output is not copied into the expressions that use it, as a
    projection's is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its line number from 0) and words of every line with words."""
    lines = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\r?\n"), words_of)).alias("paragraph", "words"))
    return lines.where(F.size("words") > 0)


def template_pairs(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    return spark.createDataFrame(rows, "family string, template string").withColumn("words", words_of(F.col("template"))).withColumn("pairs", F.array_distinct(pairs_of(F.col("words"))))


def _windows(templates: DataFrame) -> DataFrame:
    """Whole templates and their word windows, as family and words."""
    cuts = [templates.select("family", "words")]
    for n in WINDOW_WORDS:
        starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)), F.lit(max(1, n // 3)))
        cuts.append(templates.where(F.size("words") > n).select("family", "words", F.explode(starts).alias("at")).select("family", F.expr(f"slice(words, at, {n})").alias("words")))
    out = cuts[0]
    for c in cuts[1:]:
        out = out.unionByName(c)
    return out


def resemblance(pairs: Column, template: Column) -> Column:
    """Shared word pairs as a share of the shorter side's; a few words of a notice are none: at least
    ``LEAST_PAIRS`` pairs are shared, or all of a shorter template's."""
    least, shared = F.least(F.size(pairs), F.size(template)), F.size(F.array_intersect(pairs, template))
    return F.when((least > 0) & (shared >= F.least(F.lit(LEAST_PAIRS), F.size(template))), shared / least).otherwise(0.0)


class LicenceModel:
    """Vocabulary, the words in it (alone or in pairs), classifier and temperature."""

    def __init__(self, vocabulary: list[str], anchors: list[str], classifier: LogisticRegressionModel, temperature: float):
        self.anchors, self.classifier, self.temperature = anchors, classifier, temperature
        self.vocabulary = vocabulary

    def counts(self, rows: DataFrame, featured: bool = False) -> DataFrame:
        """``rows`` (``featured``: those with a gram of the vocabulary) plus their features."""
        grams = once(rows, "_grams", F.array_distinct(F.concat("words", pairs_of(F.col("words")))))
        if featured:
            grams = grams.where(F.arrays_overlap("_grams", F.lit(self.vocabulary)))
        model = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_grams", outputCol="features", binary=True)
        return model.transform(grams).drop("_grams")

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with words) plus the likeliest class and its calibrated probability."""
        raw = once(self.classifier.transform(self.counts(rows, featured=True)), "_raw", vector_to_array("rawPrediction"))
        named = with_best(raw.select(*rows.columns, "_raw"))
        return named.select(*rows.columns, F.element_at(F.lit(FAMILIES), (1 - F.col("_best.i")).cast("int")).alias("family"),
                            F.exp(-excess(self.temperature)).alias("probability"))


def with_best(raw: DataFrame) -> DataFrame:
    """Adds ``_best``: the largest margin of array ``_raw`` and its place, negated; of equal ones the first."""
    return once(raw, "_best", F.expr("greatest(" + ", ".join(f"struct(_raw[{i}] AS top, {-i} AS i)" for i in range(len(FAMILIES))) + ")"))


def excess(temperature: float) -> Column:
    """Log of the sum of the calibrated exponentials, relative to the largest."""
    return F.expr("log(" + " + ".join(f"exp((_raw[{i}] - _best.top) / {temperature}D)" for i in range(len(FAMILIES))) + ")")


def fit(docs: DataFrame) -> LicenceModel:
    """Train on the templates and a bounded sample of paragraphs of ``docs``."""
    spark = docs.sparkSession
    templates = template_pairs(spark)
    # only line numbers are ranked; the lowest hashes of all lines make the sample
    h = F.xxhash64("doc_id", "paragraph", "words")
    sample = paragraphs(docs).withColumn("h", h).orderBy("h").limit(UNKNOWN_ROWS)
    sample = stored(once(sample, "pairs", F.array_distinct(pairs_of(F.col("words")))).coalesce(2), "licence-lines")
    near = sample.join(F.broadcast(templates.select(F.col("pairs").alias("t"))), resemblance(F.col("pairs"), F.col("t")) >= LEAST_SHARED / 2, "left_anti")
    others = spark.createDataFrame([(t,) for t in OTHERS], "t string").select(words_of(F.col("t")).alias("words"))
    unknown = stored(near.select("words").unionByName(others).coalesce(2), "licence-sample")
    # the vocabulary is bounded by the templates
    n = max(1, unknown.count())
    grams = sorted(r.g for r in templates.select(F.explode(F.concat("words", "pairs")).alias("g")).distinct().collect())
    single = [g for g in grams if " " not in g]
    often = {r.w for r in unknown.select(F.explode(F.array_distinct("words")).alias("w")).where(F.col("w").isin(single)).groupBy("w").count().where(F.col("count") > max(1, COMMON * n)).select("w").collect()}
    vocabulary = [g for g in grams if " " in g or g not in often]
    anchors = sorted({w for g in vocabulary for w in g.split(" ")})
    model = LicenceModel(vocabulary, anchors, None, 1.0)
    rows = _windows(templates).unionByName(unknown.withColumn("family", F.lit(UNKNOWN)))
    label = F.array_position(F.lit(FAMILIES), F.col("family")) - 1
    back = F.pmod(F.xxhash64("words"), F.lit(4)) == 0
    rows = rows.withColumn("label", label.cast("double")).withColumn("back", back)
    # a few thousand rows: two partitions, as every iteration is a job
    counted = model.counts(rows.coalesce(2)).select("label", "back", "features").persist()
    # notices are few: they train and calibrate
    weighted = counted.where("label > 0 or not back").withColumn("weight", F.when(F.col("label") > 0, 4.0).otherwise(1.0))
    lr = LogisticRegression(family="multinomial", maxIter=ITERATIONS, regParam=L1, elasticNetParam=1.0, weightCol="weight")
    # every class has a template, so the classifier always knows all of FAMILIES
    model.classifier = lr.fit(weighted)
    raw = with_best(once(model.classifier.transform(counted.where("back")), "_raw", vector_to_array("rawPrediction")).select("label", "_raw"))
    loss = lambda t: F.coalesce(F.sum(excess(t) - (F.get("_raw", F.col("label").cast("int")) - F.col("_best.top")) / t), F.lit(0.0))
    losses = raw.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    model.temperature = min(zip(losses, TEMPERATURES))[1]
    counted.unpersist()
    return model


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Paragraphs that the classifier takes for a licence: doc_id, paragraph, family, probability, shared, confirmed."""
    found = model.score(paragraphs(docs)).where(F.col("family") != UNKNOWN).where(F.col("probability") >= LEAST_PROBABILITY)
    # few rows, written once: what follows looks at them again and again
    found = stored(once(found, "pairs", F.array_distinct(pairs_of(F.col("words")))).drop("words"), "licence-found")
    # the templates are fixed; a paragraph meets those of its family
    templates = F.broadcast(template_pairs(docs.sparkSession).groupBy("family").agg(F.collect_list("pairs").alias("templates")))
    shared = F.array_max(F.transform("templates", lambda t: resemblance(F.col("pairs"), t)))
    out = found.join(templates, "family").withColumn("shared", shared)
    return out.select("doc_id", "paragraph", "family", "probability", "shared", (F.col("shared") >= LEAST_SHARED).alias("confirmed"))


def by_document(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): its licence family (null: none) and where it stands."""
    found = scan(docs, model).dropDuplicates(["doc_id", "paragraph", "family"])
    order = F.struct(F.col("confirmed"), F.round("probability", 6).alias("probability"), (-F.col("paragraph")).alias("p"), "family")
    best = found.groupBy("doc_id").agg(F.max(order).alias("b"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
                                       F.count_if("confirmed").alias("notices"), F.count_if(~F.col("confirmed")).alias("unconfirmed"))
    best = best.withColumnRenamed("doc_id", "_d")
    ids = docs.select("doc_id")
    out = ids.join(best, ids["doc_id"].eqNullSafe(best["_d"]), "left")
    sure = F.col("b.confirmed")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.when(sure, F.col("b.family")).alias("family"), F.when(sure, F.col("b.probability")).alias("probability"),
                      F.when(sure, -F.col("b.p")).cast("int").alias("paragraph"), F.coalesce("families", F.array().cast("array<string>")).alias("families"),
                      F.coalesce("notices", zero).alias("notices"), F.coalesce("unconfirmed", zero).alias("unconfirmed"))
