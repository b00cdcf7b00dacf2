"""License scans: template markup compiled to token automata.

A template is a text with two kinds of region: `[[ words ]]` may be left out, `<<n>>` stands for any 0 to
n words. Everything else is mandatory. A text is accepted at a place when all mandatory words follow each
other exactly there, with the optional and replaceable regions between them where the template has them. Licences
are compiled whole, so a text with one term rewritten is not accepted; notices that name a licence (NOTICES) are
templates of their own.

Texts are lower-cased (A-Z only) and cut into words of digits, a-z and characters beyond ASCII, so
punctuation and layout do not matter. Automata start only where a template's opening words stand, which a
substring search finds; a text's words are counted once, whatever the number of places. The score is 1 where a
template or base phrase is accepted, else the largest share of a template's mandatory words that follow its opening
in order, else 0.

Null counts as empty; empty texts have no words, no labels and score 0. Repeated rows are scanned alike;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm._chunks import text_runs
from codeweft.llm._common import bounded_batches, documents, text_of

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_AS_IS = """THIS SOFTWARE IS PROVIDED BY <<12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
[[ 1 ]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[[ 2 ]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
#: Licences, and the notices by which files and texts name one.
LICENCES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<3>>, to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    ("isc", """Permission to use, copy, modify, and [[ or ]] distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""),
    ("bsd-2", f"{_BSD} {_AS_IS}"),
    ("bsd-3", f"""{_BSD} [[ 3 ]] Neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. {_AS_IS}"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions: [[ 1 ]] The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
[[ 2 ]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[ 3 ]] This notice may not be
removed or altered from any source distribution"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
)
NOTICES = (
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License"""),
    ("apache-2", "licensed under the apache license version 2 [[ 0 ]]"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
for more details"""),
    ("lgpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or (at your option) any later version"""),
    ("gpl-3", "licensed under the gnu general public license [[ gpl ]] version 3 [[ or later ]]"),
    ("gpl-2", "licensed under the gnu general public license [[ gpl ]] version 2 [[ or later ]]"),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/"""),
    ("cc-by-nc", "licensed under [[ a ]] [[ the ]] creative commons attribution noncommercial <<3>> license"),
    ("cc-by-sa", "licensed under [[ a ]] [[ the ]] creative commons attribution sharealike <<3>> license"),
    ("cc-by", "licensed under [[ a ]] [[ the ]] creative commons attribution [[ 4 0 ]] [[ international ]] license"),
    ("cc0", "to the extent possible under law <<12>> has waived all copyright and related or neighboring rights to <<20>> work"),
    ("mit", "spdx license identifier mit"), ("isc", "spdx license identifier isc"), ("bsd-2", "spdx license identifier bsd 2 clause"), ("bsd-3", "spdx license identifier bsd 3 clause"),
    ("apache-2", "spdx license identifier apache 2 0"), ("gpl-2", "spdx license identifier gpl 2 0 [[ or later ]] [[ only ]]"), ("gpl-3", "spdx license identifier gpl 3 0 [[ or later ]] [[ only ]]"), ("mpl-2", "spdx license identifier mpl 2 0"),
)
TEMPLATES = LICENCES + NOTICES
OPENING = 3


class Automaton:
    """States 0..n of a template; state k waits for what step k takes, n accepts."""

    def __init__(self, markup: str):
        self.steps: list[tuple[str, object]] = []
        for region in re.findall(r"\[\[.*?\]\]|<<\d+>>|[0-9a-z]+", markup.lower()):
            if region.startswith("[["):
                words = tuple(w.encode() for w in region[2:-2].split())
                self.steps += [("may", (w, len(words) - k)) if not k else ("word", w) for k, w in enumerate(words)]
            elif region.startswith("<<"):
                self.steps.append(("any", int(region[2:-2])))
            else:
                self.steps.append(("must", region.encode()))
        if [k for k, _ in self.steps[:2]] != ["must"] * 2:
            raise ValueError("a template opens with two mandatory words")
        self.mandatory = sum(k == "must" for k, _ in self.steps)
        opening = []
        for kind, w in self.steps[:OPENING]:
            if kind != "must":
                break
            opening.append(w)
        self.opening = b" " + b" ".join(opening) + b" "
        self.done = [0]  # mandatory words before each state
        for kind, _ in self.steps:
            self.done.append(self.done[-1] + (kind == "must"))

    def _closed(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With the states that are reached without a word."""
        todo, out = list(states), set(states)
        while todo:
            s, _ = todo.pop()
            if s < len(self.steps):
                kind, x = self.steps[s]
                over = (s + 1, 0) if kind == "any" else (s + x[1], 0) if kind == "may" else None
                if over and over not in out:
                    out.add(over)
                    todo.append(over)
        return out

    def run(self, words: list[bytes], at: int) -> float:
        """Share of mandatory words matched from words[at]; 1.0 where the template is accepted."""
        states, best = self._closed({(0, 0)}), 0
        for w in words[at : at + sum(x if k == "any" else 1 for k, x in self.steps)]:
            if any(s == len(self.steps) for s, _ in states):
                return 1.0
            after = set()
            for s, used in states:
                if s == len(self.steps):
                    continue
                kind, x = self.steps[s]
                if kind == "any":
                    if used < x:
                        after.add((s, used + 1))
                elif w == (x[0] if kind == "may" else x):
                    after.add((s + 1, 0))
            if not after:
                break
            states = self._closed(after)
            best = max(best, *(self.done[s] for s, _ in states))
        return 1.0 if any(s == len(self.steps) for s, _ in states) else best / self.mandatory


@lru_cache(maxsize=1)
def automata() -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, Automaton(markup)) for label, markup in TEMPLATES)


def _places(body: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which phrase (words between spaces) stands in body."""
    out, at, last, before = [], body.find(phrase), 0, 0
    while at >= 0:
        before += body.count(b" ", last, at)
        last = at
        out.append(before)
        at = body.find(phrase, at + 1)
    return out


def scan_text(text: str) -> tuple[int, list[int], set[str], set[str], float]:
    """(words, starts of base places, base labels, all labels, score)."""
    words = WORDS.findall(text.encode("utf-8", "replace").lower())
    body = b" " + b" ".join(words) + b" "
    starts, base, score = [], set(), 0.0
    for phrase, label in BASE:
        found = _places(body, b" " + phrase.encode() + b" ")
        starts += found
        base |= {label} if found else set()
    labels = set(base)
    score = 1.0 if base else 0.0
    for label, automaton in automata():
        for at in _places(body, automaton.opening):
            share = automaton.run(words, at)
            score = max(score, share)
            if share == 1.0:
                labels.add(label)
    return len(words), starts, base, labels, score


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_runs(batch.column(1)):
            n, starts, base, labels, score = zip(*map(scan_text, texts), strict=True)
            cols = [pa.array(n, pa.int64()), pa.array([len(x) for x in starts], pa.int64()), pa.array([min(x, default=None) for x in starts], pa.int64()), pa.array([max(x, default=None) for x in starts], pa.int64())]
            cols += [pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *cols], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: words, base places and their extent, labels and score."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {dict(docs.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(_scan, schema).withColumnRenamed("id", id_col)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
