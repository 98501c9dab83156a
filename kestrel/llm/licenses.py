"""Licence scans: word-bigram Dice coefficient against licence templates.

A unit (each line, each block of lines between blank lines, and the whole text) is normalised to
lower-cased runs of letters and digits.  Its score against a template is the Dice coefficient of their
sets of word bigrams; a score of at least MIN_DICE needs sizes within a fixed ratio, so only
templates within the size bounds are candidates, found by bisection of the sorted sizes.

A notice that shares its line or block with other text is found as a run of words anywhere in the text, over line
ends and blank lines: a run that reaches MIN_DICE holds one of enough rare bigrams of the template (anchors),
begins and ends with a bigram of the template and is at most a fixed ratio longer.  Of runs that overlap the best
stays (of equal scores the longest), and none is counted where a unit matches the same licence.

Defined cases: a null or empty text, or one without a matching unit, has no licence, score 0 and no
matches; a block of one line and a text of one block are not counted again; ties in score go to the first
template by name, and between units to the first line; rows that repeat are each scanned; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import per_batch, read_table

MIN_DICE = 0.8
#: A caller's own templates are bounded by this many.
MAX_TEMPLATES = 10_000

# Public licence notices, by name and wording.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form "
     "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
     "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
     "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
     "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
     "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
     "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
     "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
     "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: 1. Redistributions of source code must retain the "
     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form "
     "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder "
     "nor the names of its contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
     "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
     "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
     "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
     "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
     "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
     "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
     "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
     "or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
     "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
     "copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
     "License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
     "of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_WORD = re.compile(r"[^\W_]+")
SCHEMA = "license string, score double, first_line int, n_lines int"


def normal_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


class Matcher:
    """Templates sorted by their number of bigrams."""

    def __init__(self, templates=TEMPLATES, min_dice: float = MIN_DICE):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"at most {MAX_TEMPLATES} templates")
        known = [(bigrams(normal_words(text)), name) for name, text in templates]
        self.templates = sorted([t for t in known if t[0]], key=lambda t: (len(t[0]), t[1]))
        self.sizes = [len(t[0]) for t in self.templates]
        self.min_dice = min_dice
        # runs: each text with the bigrams it needs at least and the places a run can take
        ratio = min_dice / (2 - min_dice)
        lengths = {}
        for text, name in ((normal_words(text), name) for name, text in templates):
            lengths[bigrams(text), name] = len(text) - 1
        self.needs = [math.ceil(len(t) * ratio - 1e-9) for t, _ in self.templates]
        self.spans = [lengths[t] / ratio + 1e-9 for t in self.templates]
        uses = Counter(g for t, _ in self.templates for g in t)
        self.holders, self.anchors = defaultdict(list), defaultdict(list)
        for k, (t, _) in enumerate(self.templates):
            for g in t:
                self.holders[g].append(k)
            # a run without any of these has too few of the template's bigrams
            for g in sorted(t, key=lambda g: (uses[g], -len(g[0]) - len(g[1]), g))[:len(t) - self.needs[k] + 1]:
                self.anchors[g].append(k)

    def candidates(self, size: int) -> list[tuple[frozenset, str]]:
        """Templates whose size lets a unit of so many bigrams reach the threshold."""
        ratio = self.min_dice / (2 - self.min_dice)
        # a small margin keeps exact bounds in spite of rounding
        return self.templates[bisect_left(self.sizes, size * ratio - 1e-9):
                              bisect_right(self.sizes, size / ratio + 1e-9)]

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """(score, licence) of the best template at or above the threshold."""
        # a set has at most one bigram fewer than there are words; repeats make it smaller
        if len(words) < 2 or not self.sizes or len(words) - 1 < self.sizes[0] * self.min_dice / (2 - self.min_dice):
            return None
        own = bigrams(words)
        found = [(-2 * len(own & t) / (len(own) + len(t)), name) for t, name in self.candidates(len(own))]
        found = [f for f in found if -f[0] >= self.min_dice]
        return (-min(found)[0], min(found)[1]) if found else None

    def runs(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """(score, licence, first word, last word) of the matching runs of words, none of which overlap."""
        hit = {k for g in zip(words, words[1:], strict=False) if g in self.anchors for k in self.anchors[g]}
        if not hit:
            return []
        grams, places = list(zip(words, words[1:], strict=False)), defaultdict(list)
        for p, g in enumerate(grams):
            for k in self.holders.get(g, ()):
                if k in hit:
                    places[k].append(p)
        found = []
        for k, at in places.items():
            size, name, need, span = len(self.templates[k][0]), self.templates[k][1], self.needs[k], self.spans[k]
            for i in range(len(at) - need + 1):
                if at[i + need - 1] - at[i] >= span:
                    continue
                seen, shared, done = set(), set(), at[i]
                best = (0.0, 0)
                for p in at[i:]:
                    if p - at[i] >= span:
                        break
                    seen.update(grams[done:p + 1])
                    shared.add(grams[p])
                    done = p + 1
                    best = max(best, (2 * len(shared) / (len(seen) + size), done))
                if best[0] >= self.min_dice:
                    found.append((-best[0], at[i] - best[1], name, at[i], best[1]))
        free, out = bytearray(b"\1") * len(words), []
        for score, _, name, a, b in sorted(found):
            if all(free[a:b + 1]):
                free[a:b + 1] = bytes(b + 1 - a)
                out.append((-score, name, a, b))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, score, first line, lines) of every matching unit of a text."""
        lines = [normal_words(x) for x in (text or "").split("\n")]
        full = [k for k, w in enumerate(lines) if w]
        units = [(k, 1, lines[k]) for k in full]
        blocks, start = [], 0
        for k in range(len(lines) + 1):
            if k == len(lines) or not lines[k]:
                if k - start > 1:
                    blocks.append((start, k - start, [w for x in lines[start:k] for w in x]))
                start = k + 1
        units += blocks
        if full and not (len(blocks) == 1 and len(full) == blocks[0][1]) and len(full) > 1:
            units.append((full[0], full[-1] - full[0] + 1, [w for x in lines for w in x]))
        out = [(m[1], m[0], k, n) for k, n, words in units if (m := self.best(words))]
        runs = self.runs([w for x in lines for w in x])
        if runs:
            taken = {(name, j) for name, _, k, n in out for j in range(k, k + n)}
            line = [k for k in full for _ in lines[k]]
            out += [(name, score, line[a], line[b] - line[a] + 1) for score, name, a, b in sorted(runs, key=lambda r: r[2])
                    if not any((name, j) in taken for j in range(line[a], line[b] + 1))]
        return out


def scan(docs: DataFrame, templates=TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """Per row: doc_id and its matches, an array of (license, score, first_line, n_lines)."""
    matcher = Matcher(templates, min_dice)
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()),
                               ("first_line", pa.int32()), ("n_lines", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("license", "score", "first_line", "n_lines"), m, strict=True)) for m in matcher.scan(t)]
                 for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     f"doc_id long, matches array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its best licence, all licences found and the number of matching units."""
    matches = scan(read_table(spark, sf_dir, "documents"))
    best = F.array_min(F.transform("matches", lambda m: F.struct(
        (-m["score"]).alias("minus"), m["license"].alias("license"), m["first_line"].alias("first_line"))))
    return (matches.withColumn("best", best).select(
        "doc_id", F.col("best.license").alias("license"), F.coalesce(-F.col("best.minus"), F.lit(0.0)).alias("score"),
        F.col("best.first_line").alias("first_line"),
        F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))).alias("licenses"),
        F.size("matches").alias("n_matches")))
