"""Licence scan: a trained paragraph classifier, confirmed by template comparison. Scoring is DataFrame and SQL functions alone.

Features are the word 1- and 2-grams of the templates that at most one in ``RARE_LINES`` distinct lines of the corpus holds.
Every line of every text is scored: its words and word pairs meet the features in a broadcast join, so a line without any
has the bias alone. The model is a sparse softmax regression over the families, ``none`` and ``unknown`` (a licence of no
known family). Consecutive lines that are no ``none`` are one paragraph, which is scored again as a whole, so that a notice that is
wrapped over lines is seen whole. A family stands only if its probability is at least ``SURE`` and the paragraph is confirmed by one of
the family's templates: half of the template's features are in the paragraph, or half of the paragraph's in the template.
Other paragraphs are unknown; a paragraph that is ``none`` as a whole is left out.

The fit takes the templates and parts of them, with words left out; for ``unknown`` notices of no family and mixtures of families;
for ``none`` a few features by chance. The softmax's temperature is fitted on texts that the fit hasn't seen: the last template
of each class.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

RARE_LINES = 4_000
SURE = 0.6
NONE, UNKNOWN = "none", "unknown"

#: Common notices of licence families, and paragraphs of their texts; the last one of each is for the temperature.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "This project is made available under the Apache License, version 2.0. See LICENSE for the full text.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for license information.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This code is distributed under the terms of the MIT License.",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Distributed under the BSD license. Released under the 3-clause BSD License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 2 or later, the GNU General Public License.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Distributed under the terms of the GNU Lesser General Public License, the LGPL.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0 (MPL).",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "The text is available under the Creative Commons Attribution License 4.0, CC BY 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available for non-commercial use under the Creative Commons Attribution-NonCommercial License, CC BY-NC.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "This work has been dedicated to the public domain under CC0 1.0.",
    ],
}
#: Notices of no known family.
OTHER_NOTICES = [
    "All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher.",
    "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "Use of this software is subject to the terms of the end user license agreement that came with the product.",
    "Licensed to the customer under a commercial license agreement; redistribution is not permitted.",
    "This file is provided under a dual license that is described in the accompanying agreement.",
    "You may use this material for evaluation only. Any other use requires a separate written license from the owner.",
    "Copyright of the author. Licensed for internal use only, not for redistribution or modification.",
    "The license granted herein is personal, non-exclusive and non-transferable.",
]

_SPLIT = "[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def _grams(words: list[str]) -> list[str]:
    return [*words, *(" ".join(p) for p in zip(words, words[1:]))]


def template_grams() -> list[str]:
    texts = [t for many in TEMPLATES.values() for t in many] + OTHER_NOTICES
    return sorted({g for t in texts for g in _grams(_words(t)) if len(g) > 1})


@dataclass
class Model:
    grams: list[str]
    classes: list[str]
    weights: list[list[float]]  # of each gram, for each class
    bias: list[float]
    templates: list[list[list[int]]]  # of each class, the features of each template

    def scores(self, words: list[str]) -> np.ndarray:
        """Probabilities of the classes, for comparison: scoring itself is done by ``scan``."""
        place = {g: i for i, g in enumerate(self.grams)}
        z = np.array(self.bias) + sum((np.array(self.weights[place[g]]) for g in set(_grams(words)) if g in place), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return e / e.sum()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(grams: list[str], seed: int = 11, steps: int = 250) -> Model:
    """Softmax regression on variants of the templates over the features ``grams``; the last template of each class fits the temperature."""
    rng = np.random.default_rng(seed)
    classes, place = [NONE, UNKNOWN, *TEMPLATES], {g: i for i, g in enumerate(grams)}
    rows: list[tuple[list[str], int, bool]] = []

    def add(texts: list[str], k: int) -> None:
        for i, t in enumerate(texts):
            words, held = _words(t), i == len(texts) - 1
            rows.append((words, k, held))
            for _ in range(12):
                cut = words
                if len(words) > 24 and rng.random() < 0.5:  # a part, as a wrapped line
                    a = int(rng.integers(0, len(words) - 12))
                    cut = words[a : a + int(rng.integers(8, 25))]
                rows.append(([w for w in cut if rng.random() > 0.12], k, held))

    for k, texts in enumerate(TEMPLATES.values(), 2):
        add(texts, k)
    add(OTHER_NOTICES, 1)
    families = [_words(t) for many in TEMPLATES.values() for t in many]
    for i in range(60):  # pieces of several families
        parts = [families[j] for j in rng.choice(len(families), 3, replace=False)]
        rows.append((sum((p[: max(2, len(p) // 3)] for p in parts), []), 1, i % 5 == 0))
    x, y, out = np.zeros((len(rows) + 200, len(grams)), np.float32), [], []
    for i, (words, k, held) in enumerate(rows):
        x[i, [place[g] for g in set(_grams(words)) if g in place]] = 1
        y.append(k)
        out.append(held)
    for i in range(len(rows), len(x)):  # ordinary lines have no feature, or a few by chance
        if grams:
            x[i, rng.choice(len(grams), min(len(grams), int(rng.integers(0, 4))), replace=False)] = 1
        y.append(0)
        out.append(i % 5 == 0)
    hot, out = np.eye(len(classes), dtype=np.float32)[y], np.array(out)
    w, b = np.zeros((len(grams), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    xt, yt = x[~out], hot[~out]
    for _ in range(steps):
        d = _softmax(xt @ w + b) - yt
        w -= 2.0 * (xt.T @ d / len(d) + 1e-4 * w)
        b -= 0.5 * d.mean(0)
    logits = x[out] @ w + b
    tries = np.linspace(0.3, 3, 28)
    t = float(tries[int(np.argmin([-np.log((_softmax(logits * t) * hot[out]).sum(1) + 1e-12).mean() for t in tries]))])
    templates = [[], [], *([sorted({place[g] for g in _grams(_words(t_)) if g in place}) for t_ in many] for many in TEMPLATES.values())]
    return Model(grams, classes, (w * t).round(6).tolist(), (b * t).round(6).tolist(), templates)


# --- over the corpus ------------------------------------------------------------------------------


def _line_grams(lines: DataFrame, keep: list[str], grams: list[str]) -> DataFrame:
    """``keep`` and ``gram``: a row for each word and word pair of ``line`` that begins as one of ``grams``; a line's last pair is null."""
    firsts = sorted({g.split(" ")[0] for g in grams})
    words = F.split(F.trim(F.regexp_replace(F.lower("line"), _SPLIT, " ")), " ")
    split = lines.select(*keep, words.alias("w"))
    each = split.select(*keep, F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p"))
    return each.filter(F.col("p.a").isin(firsts)).select(*keep, F.explode(F.array("p.a", F.concat("p.a", F.lit(" "), "p.b"))).alias("gram"))


def rare_grams(docs: DataFrame, column: str = "text", rare_lines: int = RARE_LINES) -> list[str]:
    """The templates' grams that at most one in ``rare_lines`` distinct lines of the corpus holds.

    Lines with an unmistakable notice word aren't counted, so that their words stay. Distinct lines are estimated from their hashes.
    """
    given = template_grams()
    lines = docs.select(F.explode(F.split(shared.text_or_empty(docs, column), "\n")).alias("line")).filter(~F.col("line").rlike("(?i)licen[sc]e|copyright|spdx"))
    known = docs.sparkSession.createDataFrame([(g,) for g in given], "gram string")
    held = _line_grams(lines.withColumn("h", F.xxhash64("line")), ["h"], given).join(F.broadcast(known), "gram")  # the templates' grams
    counts = {r.gram: r.n for r in held.groupBy("gram").agg(F.approx_count_distinct("h").alias("n")).collect()}
    total = lines.agg(F.approx_count_distinct(F.xxhash64("line"))).first()[0] or 0
    return [g for g in given if counts.get(g, 0) * rare_lines <= total]


def train(docs: DataFrame, column: str = "text", rare_lines: int = RARE_LINES) -> Model:
    return fit(rare_grams(docs, column, rare_lines))


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``licenses``: array of (line, lines, family, probability) of the licence paragraphs, in order; a column of that name is replaced.

    Lines count from 0. Null and empty texts have an empty array. Texts are told apart by their digest, so equal ones are judged once
    and repeated or null ids make no difference.
    """
    rest = docs.drop("licenses")
    key, own = shared.fresh_name(rest, "text_id"), shared.fresh_name(rest, "found")
    text_id = F.md5(shared.text_or_empty(rest, column).cast("binary"))
    texts = rest.select(text_id.alias("t"), shared.text_or_empty(rest, column).alias("x"))  # the digest before lines are made
    lines = texts.select("t", F.posexplode(F.split("x", "\n")).alias("line_no", "line"))
    features = docs.sparkSession.createDataFrame(list(enumerate(model.grams)), "feature int, gram string")
    held = _line_grams(lines, ["t", "line_no"], model.grams).join(F.broadcast(features), "gram")  # the model's features
    per_line = held.groupBy("t", "line_no").agg(F.collect_set("feature").alias("features"))

    weights, zero = _constant(model.weights, "array<array<double>>"), _constant(model.bias, "array<double>")
    logits = F.aggregate("features", zero, lambda acc, i: F.zip_with(acc, F.element_at(weights, i + 1), lambda a, b: a + b))
    share = lambda z, k: F.exp(k - F.array_max(z)) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max(z)))
    told = per_line.withColumn("z", logits).filter(share(F.col("z"), F.col("z")[0]) < 0.5)

    order = Window.partitionBy("t").orderBy("line_no")
    fresh = F.when(F.col("line_no") - F.lag("line_no").over(order) == 1, 0).otherwise(1)
    runs = told.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    paragraph = runs.groupBy("t", "run").agg(F.min("line_no").alias("line"), F.count(F.lit(1)).alias("lines"), F.array_distinct(F.flatten(F.collect_list("features"))).alias("features"))
    judged = paragraph.withColumn("z", logits).withColumn("k", F.array_position("z", F.array_max("z")).cast("int"))
    judged = judged.withColumns({"p": share(F.col("z"), F.array_max("z")), "class": F.element_at(_constant(model.classes, "array<string>"), F.col("k"))}).filter(F.col("class") != NONE)
    cases = F.element_at(_constant(model.templates, "array<array<array<int>>>"), F.col("k"))
    near = F.exists(cases, lambda c: F.size(F.array_intersect(c, "features")) * 2 >= F.least(F.size(c), F.size("features")))
    family = F.when((F.col("class") != UNKNOWN) & (F.col("p") >= SURE) & near, F.col("class")).otherwise(UNKNOWN)
    each = judged.select("t", F.struct("line", F.col("lines").cast("int").alias("lines"), family.alias("family"), F.round("p", 6).alias("probability")).alias("x"))
    found = shared.saved(each.groupBy(F.col("t").alias(key)).agg(F.array_sort(F.collect_list("x")).alias(own)), "licence-texts")
    out = rest.join(shared.sent(found), text_id == F.col(key), "left")
    return out.select(*rest.columns, F.coalesce(own, F.array().cast(found.schema[own].dataType)).alias("licenses"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_paragraphs, families, n_unknown. Null and empty texts have none; repeated rows are scanned alike."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_paragraphs"), F.array_join(F.array_remove(families, UNKNOWN), ",").alias("families"), F.size(F.filter("licenses", lambda x: x["family"] == UNKNOWN)).cast("long").alias("n_unknown"))
