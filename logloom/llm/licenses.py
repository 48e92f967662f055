"""Licence scans, native.

Documents are cut into paragraphs. A classifier over the words and word pairs of a paragraph, a sparse multinomial
logistic regression, names the licence family, unknown (a licence, but none of these) or none; its probabilities are
calibrated by a temperature on held-back examples. A prediction is confirmed if enough of the paragraph's word pairs,
or of one of the family's notices', are found in the other.

The classifier is fitted on the driver: families from NOTICES, unknown from UNFAMILIAR ones and from notices with their
telling words replaced, none from a sample of the corpus's ordinary paragraphs, whose size does not depend on the table's.
Its features are words and pairs that notices hold and ordinary paragraphs seldom do, so it is sparse: a paragraph without
any of them is none. That makes the first pass a test for such words, which loses nothing, and leaves few paragraphs to
score. Scoring is a DataFrame job: distinct, explode, broadcast lookup, sum.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import common

#: Families and notices by which they are commonly declared. Public licence notices.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "This project is available under the Apache 2.0 license.",
        "License: Apache-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "The MIT License (MIT)",
        "License: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "License: GPL-3.0-or-later",
        "License: GPLv3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "License: MPLv2",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Notices of licences that are no family here: what unknown is learnt from. Public licence notices.
UNFAMILIAR = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the EUPL, Version 1.2 or later.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This package is free software; you may use it under the terms of the Artistic License 2.0.",
    "This software is provided under the zlib license.",
    "Use of this software is subject to the terms of the Common Development and Distribution License.",
    "You may use this file under the terms of the Do What The Fuck You Want To Public License.",
    "Licensed under the PostgreSQL License.",
    "The contents of this file are licensed under the Python Software Foundation License.",
    "Contains data made available under the Open Database License (ODbL).",
    "This work is covered by the Ruby license.",
    "Licensed under the Academic Free License version 3.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: OFL-1.1",
]
NONE, UNKNOWN = "none", "unknown"
MIN_PROBABILITY, CONFIRMED = 0.5, 0.6
#: Ordinary documents and paragraphs of them that the classifier learns none from, at most; characters beyond which a paragraph is cut at sentence ends.
DOCUMENTS, ORDINARY, LONG = 512, 3_000, 600
#: Share of ordinary paragraphs above which a word tells nothing.
USUAL = 0.003
_word = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
#: Paragraph ends: blank lines, and line ends that end a sentence. Sentence ends, for long paragraphs: not after an initial or a number.
_BREAK, _SENTENCE = r"\s*\n\s*\n\s*|(?<=[.!?:])[ \t]*\r?\n[ \t]*", r"(?<=[A-Za-z)\"]{2}[.!?])[ \t\n]+"
#: Ordinary paragraphs with such words may be licences themselves, and are not learnt from.
_SUSPECT = re.compile(r"(?i)licen[cs]|copyright|spdx|\bgpl|public domain|all rights reserved|redistribut")


def words_of(text: str) -> list[str]:
    """Lower-case words of a paragraph; digits read as 0."""
    return [re.sub(r"\d", "0", w) for w in re.findall(_word, "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text))]


def word_pairs(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:]))) or words[:1]


class Classifier:
    """vocabulary (features), weights (a row a feature, a column a class), bias, temperature; telling: its single words."""

    def __init__(self, ordinary: list[str], seed: int = 5, copies: int = 16, steps: int = 160):
        rng = random.Random(seed)
        self.classes = [NONE, UNKNOWN, *NOTICES]
        plain = [words_of(t) for t in ordinary]
        seen: dict[str, int] = {}
        for p in plain:
            for w in set(p):
                seen[w] = seen.get(w, 0) + 1
        usual = {w for w, c in seen.items() if c > max(3, USUAL * len(plain))}
        usual |= set("a an and any are as at be by for from in is it its no not of on or that the their this to was were which with you your can may all".split())
        notices = [(k, words_of(t)) for k, f in enumerate(NOTICES, 2) for t in NOTICES[f]] + [(1, words_of(t)) for t in UNFAMILIAR]
        families: dict[str, set[int]] = {}
        for k, words in notices:
            for w in words:
                families.setdefault(w, set()).add(k)
        self.telling = sorted(w for w in families if w not in usual)
        pairs = {f"{a} {b}" for _, words in notices for a, b in zip(words, words[1:]) if a not in usual or b not in usual}
        self.vocabulary = self.telling + sorted(pairs)
        index = {x: i for i, x in enumerate(self.vocabulary)}
        filler = [w for p in plain for w in p][:50_000] or ["and"]
        invented = lambda: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        texts, kinds = [*plain], [0] * len(plain)

        def learn(kind: int, words: list[str]) -> None:
            around = lambda: [rng.choice(filler) for _ in range(rng.choice((0, 0, 0, 4, 12)))]
            texts.append(around() + words + around())
            kinds.append(kind)

        for k, words in notices:
            name = {w for w in words if w not in usual and len(families[w]) <= 3 and (k == 1 or 1 not in families[w])}
            for c in range(copies):
                learn(k, [w for w in words if c == 0 or len(words) < 5 or rng.random() > 0.1])
                if name and any(w.startswith("licens") for w in words):  # the same for a licence of another name
                    learn(1, [(invented() if w in name and rng.random() < 0.95 else w) for w in words if rng.random() > 0.1])
                    if k > 1 and c % 2:
                        learn(1, [w for w in words if w not in name and rng.random() > 0.1])
        names = {w for w in self.telling if len(families[w]) == 1 and re.search(r"-[0b]|\d|^(?:unlicense|gpl|mpl)", w)}  # identifiers stand alone
        for w in sorted(names):
            for _ in range(copies):
                learn(next(iter(families[w])), [w])
        stray = [w for w in self.telling if w not in names]
        common_words = [w for w in stray if len(families[w]) > 2]
        for i in range(8 * len(self.telling)):  # one or two stray words of notices among ordinary ones
            words = [rng.choice(filler) for _ in range(rng.randint(2, 25))]
            for _ in range(rng.randint(1, 2)):
                words.insert(rng.randrange(len(words)), rng.choice(common_words if i % 4 == 0 else stray))
            texts.append(words)
            kinds.append(0)
        self._fit([self.rows(t, index) for t in texts], np.array(kinds), seed, steps)

    @staticmethod
    def rows(words: list[str], index: dict[str, int]) -> np.ndarray:
        return np.array(sorted({index[x] for x in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))] if x in index}), np.int64)

    def _fit(self, rows: list[np.ndarray], kinds: np.ndarray, seed: int, steps: int) -> None:
        n, k = len(rows), len(self.classes)
        back = np.random.default_rng(seed).random(n) < 0.2
        flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
        w, b = np.zeros((len(self.vocabulary), k)), np.zeros(k)
        weight = np.where(back, 0.0, 1.0) / np.bincount(kinds, weights=~back, minlength=k)[kinds].clip(1)
        weight[kinds < 2] *= 4
        weight /= weight.sum()
        y = np.eye(k)[kinds]
        g2w, g2b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        order = np.argsort(flat, kind="stable")
        used, starts = np.unique(flat[order], return_index=True)
        by_feature, ends = owner[order], np.cumsum([0, *(len(r) for r in rows)])

        def logits() -> np.ndarray:
            sums = np.concatenate([np.zeros((1, k)), np.cumsum(w[flat], axis=0)])
            return sums[ends[1:]] - sums[ends[:-1]] + b

        for _ in range(steps):
            z = logits()
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - y) * weight[:, None]
            gw = 1e-5 * w
            gw[used] += np.add.reduceat(d[by_feature], starts, axis=0)
            gb = d.sum(axis=0)
            g2w += gw * gw
            g2b += gb * gb
            w -= 0.3 * gw / np.sqrt(g2w)
            b -= 0.3 * gb / np.sqrt(g2b)
        self.weights, self.bias = w, b
        z = logits()[back]

        def loss(t: float) -> float:
            s = z / t - (z / t).max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), kinds[back]]).mean())

        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss) if back.any() else 1.0
        if b.argmax() != 0:
            raise ValueError("a paragraph without features would not be none")

    def probabilities(self, text: str) -> np.ndarray:
        """Of one paragraph, class by class."""
        index = {x: i for i, x in enumerate(self.vocabulary)}
        z = (self.weights[self.rows(words_of(text), index)].sum(axis=0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def paragraphs_of(text: Column) -> Column:
    """Array of a text's paragraphs: between blank lines or after a line that ends a sentence; those longer than LONG characters are
    cut at sentence ends."""
    return F.flatten(F.transform(F.split(text, _BREAK), lambda p: F.when(F.length(p) > LONG, F.split(p, _SENTENCE)).otherwise(F.array(p))))


def _words(text: Column) -> Column:
    """As words_of()."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.regexp_extract_all(low, F.lit(_word), F.lit(0))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, ordinary: int = ORDINARY) -> Classifier:
    """From the notices, and at most `ordinary` paragraphs of at most `documents` documents, drawn by hash."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    some = docs.where(F.col(text_col).isNotNull() & (draw < min(1.0, 2.0 * documents / max(n, 1)))).select(F.col(text_col).alias("text")).distinct()
    some = some.orderBy(F.xxhash64("text"), "text").limit(documents)
    parts = some.select(F.explode(paragraphs_of(F.col("text"))).alias("part")).where(F.length("part").between(1, LONG)).distinct().orderBy(F.xxhash64("part"), "part").limit(ordinary)
    return Classifier([r["part"] for r in parts.collect() if not _SUSPECT.search(r["part"])])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", min_probability: float = MIN_PROBABILITY, confirmed: float = CONFIRMED) -> DataFrame:
    """doc_id, paragraph (number from 0), family, guess, probability, likeness: one row for each paragraph that is not classed as
    none. guess is the likeliest class, probability its own; likeness is the largest share of word pairs (words, where there
    is but one) that the paragraph and one of the guess's notices have of the smaller of the two, 0 for unknown. family is
    the guess if its probability reaches min_probability and its likeness `confirmed`, else unknown.

    Null and empty texts have no paragraphs. Rows of equal id are told apart by their text's hash, equal rows are
    reported once; null ids are reported. Other columns are left out.
    """
    spark = docs.sparkSession
    k = len(model.classes)
    telling = F.array(*map(F.lit, model.telling))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # a paragraph without a telling word has no feature at all
    keyed = given.where(F.arrays_overlap(_words(F.col("text")), telling)).withColumn("row", F.xxhash64("text"))
    key = ["doc_id", "row", "paragraph"]
    cut = keyed.select("doc_id", "row", F.posexplode(paragraphs_of(F.col("text"))).alias("paragraph", "part")).select(*key, _words(F.col("part")).alias("words"))
    cut = cut.where(F.arrays_overlap("words", telling)).dropDuplicates(key)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("words", i), F.get("words", i)))
    featured = cut.withColumn("pairs", F.array_distinct(pairs)).withColumn("features", F.array_intersect(F.concat("words", "pairs"), F.array(*map(F.lit, model.vocabulary))))
    rows = [(x, *map(float, model.weights[i])) for i, x in enumerate(model.vocabulary)]
    table = spark.createDataFrame(rows, "feature string, " + ", ".join(f"w{i} double" for i in range(k)))
    sums = (
        featured.select(*key, "pairs", F.explode("features").alias("feature"))
        .join(F.broadcast(table), "feature")
        .groupBy(*key)
        .agg(F.first("pairs").alias("pairs"), *(F.sum(f"w{i}").alias(f"s{i}") for i in range(k)))
    )
    logits = F.array(*((F.col(f"s{i}") + float(model.bias[i])) / model.temperature for i in range(k)))
    scored = sums.withColumn("z", logits).withColumn("top", F.array_max("z")).withColumn("total", F.aggregate(F.transform("z", lambda z: F.exp(z - F.col("top"))), F.lit(0.0), lambda a, e: a + e))
    names = F.array(*map(F.lit, model.classes))
    scored = scored.withColumn("best", F.element_at(names, F.array_position("z", F.col("top")).cast("int"))).withColumn("probability", 1 / F.col("total")).where(F.col("best") != NONE)
    likeness = F.lit(0.0)
    for family, notices in NOTICES.items():
        own = [F.size(F.array_intersect("pairs", a)) / F.least(F.size("pairs"), F.size(a)) for t in notices for a in [F.array(*map(F.lit, word_pairs(words_of(t))))]]
        likeness = F.when(F.col("best") == family, F.greatest(*own, F.lit(0.0))).otherwise(likeness)
    sure = (F.col("probability") >= min_probability) & (F.col("likeness") >= confirmed)
    return scored.withColumn("likeness", likeness).select("doc_id", "paragraph", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), F.col("best").alias("guess"), "probability", "likeness")


def op9_license_scan(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
