"""Licence scans with a trained paragraph classifier (operator 4).

A paragraph's features are its word unigrams and bigrams. Sparse multinomial logistic regression (the trainer of the language
operator) is fitted on variants of the licence templates below (words dropped, words of the corpus around them, holders and
years) and, for the class `unknown`, on paragraphs drawn from the corpus and on sentences that use the words of licences for
other things. One temperature, fitted on examples kept aside, calibrates all classes, `unknown` included. A prediction stands
only if a template of the family confirms it: `CONFIRMED` of the template's five-word shingles must be in the paragraph; a
template of fewer words must be in it whole.

A block ends at a blank line and at a line end behind closing punctuation. Within a block a line end before anything but a
small letter ends a paragraph as well, for headings and lists have no full stop; but a licence may be wrapped there, so if the
paragraph alone is not confirmed it is tried together with up to `JOINED` paragraphs that follow it in the block. Every
paragraph is scored by the classifier.

Input: documents (doc_id, text). Result: a row for each document: doc_id, n_paragraphs, n_licensed (confirmed paragraphs),
families (the distinct ones in order, joined by |; empty if none), family (of the most probable confirmed paragraph, else
`unknown`), score (its probability, 0 if none), similarity (its share of the template's shingles, 0 if none). Null texts count
as empty. Null and repeated doc_ids are kept. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import short, texts
from foliomill.llm.langid import ftrl, softmax, temperature

UNKNOWN = "unknown"
#: Most paragraphs of the corpus that stand for `unknown`, and variants of each template.
SAMPLE, VARIANTS = 1500, 24
SHINGLE, CONFIRMED, JOINED = 5, 0.8, 3

#: What licences of each family say, in public use.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 2",
        "Released under the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License",
        "Released under the BSD 2-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Mozilla Public License Version 2.0",
    ],
    "ISC": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "ISC License provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Released under the Unlicense into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Licensed under CC0 1.0 Universal",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
        "CC0 1.0 Universal Public Domain Dedication",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "You must give appropriate credit, provide a link to the license, and indicate if changes were made",
        "Creative Commons Attribution 4.0 International Public License",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original",
        "Creative Commons Attribution-ShareAlike 4.0 International Public License",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "You may not use the material for commercial purposes",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "If you remix, transform, or build upon the material, you may not distribute the modified material",
        "Creative Commons Attribution-NoDerivatives 4.0 International Public License",
    ],
    "Proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited",
        "This document is proprietary and confidential and may not be reproduced without permission",
        "All rights reserved",
    ],
}
#: Sentences that license nothing.
OTHERS = [
    "The driver lost the license after the second accident on the public road", "Permission to enter the building is granted by the office", "The apache helicopter was free to land in the field",
    "Students at MIT released a new software version under pressure", "A general without restriction is a danger to the public", "He was licensed to sell copies of the work under the law of the state",
    "The creative commons of the village is open to any person", "The source of the river is subject to the terms of the treaty", "The foundation published the conditions for any use of its land",
    "You may obtain a fishing license at the office", "The mozilla browser is free software and many people use it", "Copyright law has changed in the last years", "All rights come with duties", "The gnu is an animal of Africa",
]
WORD = re.compile(r"[a-z0-9]+")
#: Where a block ends, and where a paragraph ends within one.
BLOCK = re.compile(r"\n(?:[ \t]*\n)+|(?<=[.:;!?])[ \t]*\n")
BREAK = re.compile(r"\n(?![a-zß-öø-ÿ])")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def paragraphs(text: str) -> list[list[str]]:
    """The paragraphs of each block."""
    return [BREAK.split(block) for block in BLOCK.split(text)] if text else []


#: Shingles of each template by family.
SHINGLES = {family: [shingles(words_of(t)) for t in some] for family, some in TEMPLATES.items()}


def terms(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


def similarity(words: list[str], family: str) -> float:
    """The largest share of a template's shingles, over the family's templates, that some words hold."""
    wide = shingles(words)
    return max(sum(s in wide if len(s) == SHINGLE else holds(words, s) for s in some) / len(some) for some in SHINGLES[family])


def holds(words: list[str], part: tuple[str, ...]) -> bool:
    """Whether a template shorter than a shingle stands among some words."""
    return any(tuple(words[i : i + len(part)]) == part for i in range(len(words) - len(part) + 1))


@dataclass
class Model:
    families: list[str]
    columns: dict[str, int]
    weights: np.ndarray
    temperature: float

    def row(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = sorted(self.columns[t] for t in terms(words) if t in self.columns)
        return np.array([*at, len(self.columns)], np.int64), np.ones(len(at) + 1, np.float32)

    def predict(self, words: list[str]) -> tuple[str, float]:
        at, x = self.row(words)
        p = softmax(x @ self.weights[at] / self.temperature)
        return self.families[int(p.argmax())], float(p.max())


def examples(corpus: list[str]) -> tuple[list[list[str]], list[str]]:
    """Words and family of every example. Drawn with a fixed seed."""
    r = np.random.default_rng(11)
    filler = [words_of(p) for p in corpus] or [["text"]]
    rows: list[list[str]] = []
    of: list[str] = []
    for family, some in TEMPLATES.items():
        brief = [words_of(t) for t in some if len(words_of(t)) < SHINGLE]
        for t in some:
            words = words_of(t)
            if words in brief and len(brief) < len(some):  # shares the variants of the longer one that begins with it
                continue
            start = next((b for b in brief if words[: len(b)] == b), None)
            for k in range(VARIANTS):
                kept = [w for w in words if k < 4 or r.random() > 0.06] or words
                if start and k >= VARIANTS // 2:
                    kept = start
                around = filler[r.integers(len(filler))][: int(r.integers(0, 25))] if k % 2 else []
                holder = ["copyright", str(r.integers(1990, 2030)), "the", "authors"] if k % 5 == 4 else []
                rows.append([*around, *holder, *kept] if k % 4 < 2 else [*holder, *kept, *around])
                of.append(family)
    own = [t for some in SHINGLES.values() for s in some for t in s]
    short = [t for t in own if len(t) < SHINGLE]
    for words in filler + [words_of(t) for t in OTHERS for _ in range(VARIANTS)]:
        if not shingles(words).intersection(own) and not any(holds(words, t) for t in short):
            rows.append(words)
            of.append(UNKNOWN)
    return rows, of


def train(corpus: list[str]) -> Model:
    """A model with paragraphs of `corpus` for the class unknown."""
    rows, of = examples(corpus)
    columns: dict[str, int] = {}
    for words in [words_of(t) for some in TEMPLATES.values() for t in some] + [words_of(t) for t in OTHERS]:
        for t in sorted(terms(words)):
            columns.setdefault(t, len(columns))
    families = [*TEMPLATES, UNKNOWN]
    y = np.array([families.index(f) for f in of])
    model = Model(families, columns, np.zeros((len(columns) + 1, len(families)), np.float32), 1.0)
    data = [model.row(w) for w in rows]
    apart = np.random.default_rng(3).random(len(y)) < 0.2
    fitted = np.flatnonzero(~apart)
    model.weights = ftrl([data[i] for i in fitted], y[fitted], len(columns) + 1, len(families), epochs=4, l1=0.1)
    model.temperature = temperature(np.array([data[i][1] @ model.weights[data[i][0]] for i in np.flatnonzero(apart)]), y[apart])
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model whose unknown class has learned from at most `sample` paragraphs: one of each document drawn by a hash of doc_id,
    anywhere in the text, whole."""
    rows = texts(docs).where("text <> ''")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("licence sample")), F.lit(1 << 30))
    share = min(1.0, 2 * sample / max(rows.count(), 1))  # so that tasks send few rows more than are taken

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            found = []
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                all_ = [p for block in paragraphs(text) for p in block]
                found.append(" ".join(words_of(all_[number % len(all_)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["drawn", "words"])

    some = rows.where(drawn < int(share * (1 << 30)) + 1).select(drawn.alias("drawn"), "text").mapInArrow(one, "drawn long, words string")
    return train([r.words for r in some.orderBy("drawn", "words").limit(sample).collect()])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """The licences of every document."""

    def judged(words: list[str]) -> tuple[float, float, str] | None:
        family, p = model.predict(words)
        return (p, s, family) if family != UNKNOWN and (s := similarity(words, family)) >= CONFIRMED else None

    def one(text: str) -> tuple[int, int, str, str, float, float]:
        n, found = 0, []
        for block in paragraphs(text):
            words = [words_of(p) for p in block]
            n, i = n + len(block), 0
            while i < len(block):
                used, hit = 1, judged(words[i])
                # a licence that is wrapped before a capital: the joined lines are tried only where this one has a word of a template
                for more in range(2, min(JOINED + 1, len(block) - i) + 1) if not hit and any(w in model.columns for w in words[i]) else ():
                    if hit := judged([w for part in words[i : i + more] for w in part]):
                        used = more
                        break
                if hit:
                    found.append(hit)
                i += used
        p, s, family = max(found, default=(0.0, 0.0, UNKNOWN))
        return n, len(found), "|".join(sorted({f for _, _, f in found})), family, p, s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            cols = [*zip(*(one(t or "") for t in batch.column(1).to_pylist()))] or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "n_paragraphs", "n_licensed", "families", "family", "score", "similarity"])

    return texts(docs).mapInArrow(run, "doc_id long, n_paragraphs int, n_licensed int, families string, family string, score double, similarity double")
