"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Text is lower-cased (A-Z) and taken as words of ASCII letters and digits or other characters beyond ASCII; everything else separates. Every line, every
paragraph (lines between lines without words) and the whole text is a unit. A unit and a template are compared as sets of word bigrams:
dice = 2 * common / (unit + template). Bigrams that occur in a template are marked for all texts at once; units with too few marked bigrams for the
smallest template are dropped, and sizes bound which templates a unit is compared with: dice can't reach t unless the smaller set has at least
t / (2 - t) of the larger one's bigrams.

Templates that no unit matches are looked for in windows: any run of words of the text, across lines and paragraphs. A text is searched for a template if
it holds t / (2 - t) of its bigrams. The search is exact: it leaves out only beginnings from which no window can be better than the best so far.
"""

from __future__ import annotations

from functools import cache
from importlib import resources
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text, shared

THRESHOLD = 0.9

# Public licence texts and notices, by identifier.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "MIT notice 2": "Licensed under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice 2": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice 2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice 2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

# Further notices and short texts. Whole licence texts are in licence_texts, by identifier.
_OR_LATER = """; either version {0} of the License, or (at your option) any later version.

This {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."""
MORE_TEMPLATES = {
    "Proprietary notice": "All rights reserved.",
    "BSD-3-Clause": TEMPLATES["BSD-2-Clause"].replace(
        "\n\nTHIS SOFTWARE",
        "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    + _OR_LATER.format("2", "program", ""),
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
    + _OR_LATER.format("2.1", "library", "Lesser "),
    "LGPL-3.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
    + _OR_LATER.format("3", "library", "Lesser "),
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"
    + _OR_LATER.format("3", "program", "Affero "),
}


@cache
def every_template() -> dict[str, str]:
    """TEMPLATES, MORE_TEMPLATES and the whole licence texts."""
    texts = [f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")]
    return TEMPLATES | MORE_TEMPLATES | {f.name[:-4] + " text": f.read_text("utf-8") for f in texts}


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NEXT = np.uint64(0x9E3779B97F4A7C15)


class Match(NamedTuple):
    template: str
    dice: float
    start: int  # bytes of the unit or window in its text
    end: int


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of normalised words, and the offsets of each text's."""
    n = len(data)
    inside = _WORD[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offs] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, _text.hashes(_text.lowered(data), starts, ends), np.searchsorted(starts, offs)


class Templates:
    """Bigram sets of templates."""

    def __init__(self, texts: dict[str, str], threshold: float):
        if not 0.5 < threshold <= 1:
            raise ValueError("the threshold must be above one half: windows end where dice is below it")
        self.threshold, self.names = threshold, sorted(texts)
        self.sets = []
        for name in self.names:
            data = np.frombuffer(texts[name].encode(), np.uint8)
            h = _words(data, np.array([0, len(data)]))[2]
            self.sets.append(np.unique(_text.mix(h[:-1] * _NEXT + h[1:])))
        self.every = np.unique(np.concatenate(self.sets))
        self.least = min(map(len, self.sets)) * threshold / (2 - threshold)
        self.holds = np.stack([np.isin(self.every, own) for own in self.sets], axis=1)  # bigram x template
        self.needs = np.array([len(own) for own in self.sets]) * threshold / (2 - threshold) - 1e-9

    def compare(self, bigrams: np.ndarray) -> list[tuple[str, float]]:
        """Templates that a unit's distinct bigrams match."""
        n, out, t = len(bigrams), [], self.threshold
        for name, own in zip(self.names, self.sets, strict=True):
            if min(n, len(own)) * (2 - t) >= t * max(n, len(own)) - 1e-9:
                dice = 2.0 * len(np.intersect1d(bigrams, own, assume_unique=True)) / (n + len(own))
                if dice >= t:
                    out.append((name, dice))
        return out


def window(bigrams: np.ndarray, own: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(dice, first, last bigram) of the window of a text's bigrams that is most like the distinct bigrams own; the first if several; None below least.

    All ends are tried from a beginning, until the window has three times the template's bigrams (dice is below 1/2 from there on) or all that the text has of
    it. If no end gives more than u, a beginning s further on gives at most u * m / (m - s) with m the template's bigrams: to leave one out takes at
    most one common bigram less, and one distinct bigram less, for each step. The next beginning is the first that this doesn't rule out.
    """
    n, m = len(bigrams), len(own)
    member = own[np.minimum(np.searchsorted(own, bigrams), m - 1)] == bigrams
    order = np.argsort(bigrams, kind="stable")
    same = bigrams[order[1:]] == bigrams[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    begins, held = np.flatnonzero(member), int((member & (before < 0)).sum())
    best, found, k = 0.0, None, 0
    while k < len(begins) and best < 1:
        at, size = int(begins[k]), 4 * m
        while True:
            fresh = before[at : at + size] < at
            distinct, common = np.cumsum(fresh), np.cumsum(fresh & member[at : at + size])
            if at + size >= n or common[-1] == held or distinct[-1] > 3 * m:
                break
            size *= 2
        dice = 2.0 * common / (distinct + m)
        end = int(np.argmax(dice))
        if dice[end] >= least and dice[end] > best:
            best, found = float(dice[end]), (float(dice[end]), at, at + end)
        most = float(dice[end])
        if at + size < n and common[-1] < held:
            most = max(most, 2.0 * m / (int(distinct[-1]) + m))
        k = int(np.searchsorted(begins, at + max(1, int(m * (1 - most / max(best, least)) - 1e-6))))
    return found


def scan(data: np.ndarray, offs: np.ndarray, templates: Templates) -> list[list[Match]]:
    """The matches of each text of a chunk: of every template the best unit, else the best window, the first if several are."""
    starts, ends, h, at = _words(data, offs)
    out: list[list[Match]] = [[] for _ in range(len(offs) - 1)]
    if len(h) < 2:
        return out
    bigrams = _text.mix(h[:-1] * _NEXT + h[1:])
    spot = np.minimum(np.searchsorted(templates.every, bigrams), len(templates.every) - 1)
    known = templates.every[spot] == bigrams
    marked = np.concatenate([[0], np.cumsum(known)])
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    between = breaks[starts[1:]] - breaks[ends[:-1]]
    edge = np.zeros(len(h), bool)
    edge[at[:-1][at[:-1] < len(h)]] = True
    units = [(at[:-1], at[1:])]
    for lines in (1, 2):  # a line ends at one break, a paragraph where two or more lie between words
        first = edge.copy()
        first[1:] |= between >= lines
        begin = np.flatnonzero(first)
        units.append((begin, np.append(begin[1:], len(h))))
    begin, end = (np.concatenate([u[k] for u in units]) for k in (0, 1))
    begin, end = np.unique(np.stack([begin, end])[:, end - begin >= 2], axis=1)
    good = marked[end - 1] - marked[begin] >= templates.least
    best: dict[tuple[int, str], Match] = {}
    for i, j in zip(begin[good].tolist(), end[good].tolist(), strict=True):
        text = int(np.searchsorted(at, i, "right")) - 1
        for name, dice in templates.compare(np.unique(bigrams[i : j - 1])):
            if (text, name) not in best or dice > best[text, name].dice:
                best[text, name] = Match(name, dice, int(starts[i] - offs[text]), int(ends[j - 1] - offs[text]))
    long = np.flatnonzero(at[1:] - at[:-1] >= 2)
    for text in long[marked[at[long + 1] - 1] - marked[at[long]] >= templates.least].tolist():
        i, j = int(at[text]), int(at[text + 1])
        held = templates.holds[np.unique(spot[i : j - 1][known[i : j - 1]])].sum(axis=0)
        for own in np.flatnonzero(held >= templates.needs).tolist():
            name = templates.names[own]
            if (text, name) not in best and (hit := window(bigrams[i : j - 1], templates.sets[own], templates.threshold)):
                dice, first, last = hit
                best[text, name] = Match(name, dice, int(starts[i + first] - offs[text]), int(ends[i + last + 1] - offs[text]))
    for (text, _), match in sorted(best.items()):
        out[text].append(match)
    return out


def licence_scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with licences: an array of (template, dice, start, end) of every template that a unit or a window of the text matches, in order of template.

    start and end are bytes of the best unit, or of the best window where no unit matches (the first, if several are), in the text. A short notice within a longer
    text that matches counts too. Null, empty and wordless texts match nothing; a unit needs two words. The threshold must be above one half.
    One pass, no shuffle; whole texts are scanned. Repeated rows are each scanned; an empty table gives an empty one. Columns of docs named licences are replaced.
    """
    own = Templates(every_template() if templates is None else templates, threshold)
    kind = pa.list_(pa.struct([("template", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def judge(column: pa.Array) -> list[pa.Array]:
        data, offs = _text.text_bytes(column)
        found = [m for _, _, d, o in _text.chunks(data, offs) for m in scan(d, o, own)]
        return [pa.array([[m._asdict() for m in row] for row in found], kind)]

    return shared.annotated(docs, text, "licences array<struct<template:string,dice:double,start:bigint,end:bigint>>", judge)


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_licences, licences (templates, joined by ;), best_dice (0: none) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licence_scan(docs).selectExpr(
        "doc_id",
        "cast(size(licences) as bigint) as n_licences",
        "array_join(transform(licences, x -> x.template), ';') as licences",
        "round(coalesce(array_max(transform(licences, x -> x.dice)), 0.0D), 6) as best_dice",
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PAIRS = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
_SPLIT = "regexp_extract_all({}, '(?:[a-z0-9]|[^\\x00-\\x7F])+')"

# Units first; templates that no unit of a text matches are compared with every window of it that begins and ends with one of their bigrams.
OP5_SQL = f"""
WITH t AS (SELECT name, {_PAIRS} AS b FROM (SELECT name, {_SPLIT.format(_LOW.format("body"))} AS w
       FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(every_template().items()))}) v(name, body))),
 u AS (SELECT DISTINCT doc_id, unnest(list_concat([x], string_split(x, chr(10)), regexp_split_to_array(x, '\\n(?:[\\x00-\\x09\\x0B-/:-@\\[-`{{-\\x7F]*\\n)+'))) AS unit
       FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
 p AS (SELECT doc_id, {_PAIRS} AS b FROM (SELECT doc_id, {_SPLIT.format(_LOW.format("unit"))} AS w FROM u) WHERE len(w) > 1),
 m AS (SELECT doc_id, name, max(dice) AS dice FROM (SELECT doc_id, name, 2.0e0 * len(list_intersect(p.b, t.b)) / (len(p.b) + len(t.b)) AS dice FROM p, t
       WHERE least(len(p.b), len(t.b)) * (2 - {THRESHOLD}e0) >= {THRESHOLD}e0 * greatest(len(p.b), len(t.b)) - 1e-9) WHERE dice >= {THRESHOLD}e0 GROUP BY doc_id, name),
 x AS (SELECT doc_id, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS g FROM (SELECT doc_id, {_SPLIT.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents) WHERE len(w) > 1),
 e AS (SELECT doc_id, unnest(g) AS pair, unnest(range(1, len(g) + 1)) AS pos FROM x),
 h AS (SELECT doc_id, name, pos, pair FROM e JOIN (SELECT name, unnest(b) AS pair FROM t) USING (pair)),
 c AS (SELECT doc_id, name FROM h JOIN t USING (name) GROUP BY doc_id, name HAVING count(DISTINCT pair) >= any_value(len(b)) * {THRESHOLD}e0 / (2 - {THRESHOLD}e0) - 1e-9),
 k AS (SELECT doc_id, name FROM c ANTI JOIN m USING (doc_id, name)),
 s AS (SELECT i.doc_id, i.name, list_distinct(list_slice(x.g, i.pos, j.pos)) AS v, t.b FROM k JOIN h i ON i.doc_id = k.doc_id AND i.name = k.name
       JOIN h j ON j.doc_id = i.doc_id AND j.name = i.name AND j.pos >= i.pos JOIN x ON x.doc_id = i.doc_id JOIN t ON t.name = i.name),
 n AS (SELECT doc_id, name, max(dice) AS dice FROM (SELECT doc_id, name, 2.0e0 * len(list_intersect(v, b)) / (len(v) + len(b)) AS dice FROM s) WHERE dice >= {THRESHOLD}e0 GROUP BY doc_id, name),
 g AS (SELECT doc_id, count(*) AS n, string_agg(name, ';' ORDER BY name) AS names, max(dice) AS dice FROM (SELECT * FROM m UNION ALL SELECT * FROM n) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_licences, coalesce(names, '') AS licences, round(coalesce(dice, 0.0e0), 6) AS best_dice FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
