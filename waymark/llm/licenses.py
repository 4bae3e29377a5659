"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import arrow

#: Notices by which texts state their licence, the openings of the short licences, and those licences in full.
TEMPLATES = {
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "mit/notice": "Released under the MIT License.",
    "mit/grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0/notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "bsd/grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "isc/grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0/notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved/notice": "All rights reserved.",
    "mit/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause/text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        "HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause/text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder "
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "apache-2.0/boilerplate": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-2.0/header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "lgpl-2.1/header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "agpl-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "epl-2.0/notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0"
    ),
    "zlib/text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
        "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked "
        "as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "unlicense/text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means."
    ),
}
#: For windows only, as the SQL of the scan holds TEMPLATES: usual variants of the notices.
VARIANTS = TEMPLATES | {
    "apache-2.0/short": "Licensed under the Apache License 2.0",
    "apache-2.0/title": "Apache License Version 2.0",
    "mit/licensed": "Licensed under the MIT License.",
    "mit/distributed": "distributed under the terms of the MIT license",
    "gpl-3.0/short": "Licensed under the GNU GPL v3",
    "gpl-3.0/title": "GNU General Public License v3.0",
    "bsd/notice": "Licensed under the BSD License.",
    "mpl-2.0/short": "Licensed under the Mozilla Public License 2.0",
    "cc-by-4.0/title": "Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0/title": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4.0/title": "Creative Commons Attribution-NonCommercial 4.0 International License",
}
_WORD = re.compile(rb"[a-z0-9]+")


def bigrams(text: bytes) -> frozenset[bytes]:
    """Pairs of neighbouring words, words being runs of a-z and 0-9 after lower-casing A-Z."""
    words = _WORD.findall(text.lower())
    return frozenset(map(b" ".join, zip(words, words[1:])))  # noqa: B905


class Matcher:
    """Finds, for a set of bigrams, the most alike template at or above the threshold.

    2|A∩B| / (|A|+|B|) is at most 2 min / (|A|+|B|), so only templates of size t/(2-t)|A| .. (2-t)/t|A| are looked at; the
    smallest of those sizes also tells which texts are out of every template's reach.
    """

    def __init__(self, templates: dict[str, str], percent: int):
        self.percent = percent
        self.sets = sorted(((n, k, b) for k, t in templates.items() if (n := len(b := bigrams(t.encode())))), key=lambda x: x[:2])
        t = percent
        most = max((n for n, _, _ in self.sets), default=0)
        self.longest = most * (200 - t) // t
        self.by_size: dict[int, list] = {
            a: [x for x in self.sets if 200 * min(a, x[0]) >= t * (a + x[0])] for a in range(1, self.longest + 1)
        }
        self.vocabulary = frozenset().union(*(b for _, _, b in self.sets))

    def best(self, found: frozenset[bytes]) -> tuple[str, int, int] | None:
        """Template, shared bigrams, and the sum of both sizes; ties to the smaller name."""
        out = None
        if 0 < len(found) <= self.longest and not found.isdisjoint(self.vocabulary):
            for n, key, b in self.by_size[len(found)]:
                shared, total = len(found & b), n + len(found)
                if 200 * shared >= self.percent * total and (
                    out is None or shared * out[2] > out[1] * total or (shared * out[2] == out[1] * total and key < out[0])
                ):
                    out = (key, shared, total)
        return out


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Lines, paragraphs and whole texts that match a template: doc_id, unit, first_line, last_line, license, shared, total, dice.

    Lines end with a newline; a paragraph is a run of lines that hold a word; units of one line count as lines, and a text
    of one paragraph as a paragraph. `templates` is a small table of names and texts that goes with the tasks. Texts may be
    of any length; null and empty ones have no unit. Rows with repeated or null ids are scanned like others.
    """
    kind = dict(docs.dtypes)[id_col]
    table = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(table, percent)
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), arrow.texts(part, "text"), strict=True):
                    rows += ((doc, *row) for row in units(text.encode(), match))
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                types = [part.schema.field("doc_id").type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "unit", "first_line", "last_line", "license", "shared", "total"],
                )

    schema = f"doc_id {kind}, unit string, first_line int, last_line int, license string, shared int, total int"
    hits = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow.tidy(run), schema)
    return hits.withColumn("dice", 2.0 * F.col("shared") / F.col("total"))


class Windows:
    """Finds stretches of words, wherever they begin and end, whose bigrams are like a template's.

    A stretch has at most (2-t)/t times as many bigrams as the template. At its ends stand bigrams of the template, since
    leaving others out there never makes it less alike; and it has at least t/(2-t) of the template's.
    """

    def __init__(self, templates: dict[str, str], percent: int):
        self.percent = percent
        self.sets = {k: b for k, t in templates.items() if (b := bigrams(t.encode()))}
        self.of: dict[bytes, list[str]] = {}
        for k, b in self.sets.items():
            for x in b:
                self.of.setdefault(x, []).append(k)
        # Most words are in no template, so pairs are joined only where both are.
        self.first, self.second = ({x.split()[i] for x in self.of} for i in (0, 1))

    def candidates(self, raw: bytes) -> Iterator[tuple[int, int, str, int, int]]:
        """(first word, last word, template, shared, sum of sizes) of every stretch at or above the threshold."""
        words = _WORD.findall(raw.lower())
        places: dict[str, list[int]] = {}
        first, second = self.first, self.second
        for i, a in enumerate(words[:-1]):
            if a in first and words[i + 1] in second:
                for key in self.of.get(a + b" " + words[i + 1], ()):
                    places.setdefault(key, []).append(i)
        pair = lambda i: words[i] + b" " + words[i + 1]
        for key, at in places.items():
            own, t = self.sets[key], self.percent
            n = len(own)
            most, need = n * (200 - t) // t, -(-n * t // (200 - t))
            if len(at) < need:
                continue
            inside: Counter = Counter()
            end = 0
            for k, start in enumerate(at):
                while end < len(at) and at[end] < start + most:
                    inside[pair(at[end])] += 1
                    end += 1
                if len(inside) >= need:
                    seen: set[bytes] = set()
                    shared, j = 0, start
                    for stop in at[k:end]:
                        seen.update(map(pair, range(j, stop)))
                        x = pair(stop)
                        shared += x not in seen
                        seen.add(x)
                        j = stop + 1
                        if 200 * shared >= t * (n + len(seen)):
                            yield start, stop + 1, key, shared, n + len(seen)
                gone = pair(start)
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]

    def best(self, raw: bytes) -> list[tuple[int, int, str, int, int]]:
        """Of stretches that overlap the most alike; equal ones by more shared bigrams, then place, then name."""
        out: list[tuple[int, int, str, int, int]] = []
        for x in sorted(self.candidates(raw), key=lambda x: (-x[3] / x[4], -x[3], x[0], x[1], x[2])):
            i = bisect_left(out, x[:1])
            if (i == 0 or out[i - 1][1] < x[0]) and (i == len(out) or x[1] < out[i][0]):
                out.insert(i, x)
        return out


def windows(
    docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Stretches of words that match a template, wherever they stand in a text: doc_id, first_word, last_word, license, shared,
    total, dice. Lines and paragraphs do not matter; stretches of one text do not overlap. Rows as in scan()."""
    kind = dict(docs.dtypes)[id_col]
    table = VARIANTS if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Windows(table, percent)
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), arrow.texts(part, "text"), strict=True):
                    rows += ((doc, *row) for row in match.best(text.encode()))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                types = [part.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "first_word", "last_word", "license", "shared", "total"],
                )

    schema = f"doc_id {kind}, first_word bigint, last_word bigint, license string, shared int, total int"
    hits = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow.tidy(run), schema)
    return hits.withColumn("dice", 2.0 * F.col("shared") / F.col("total"))


def units(raw: bytes, match: Matcher) -> Iterator[tuple]:
    """(unit, first line, last line, licence, shared, total) of the matching units of one text."""
    lines = raw.split(b"\n")
    most = match.longest
    kept: list[frozenset | None] = []  # bigrams of each line; None: too many for any template
    for k, line in enumerate(lines):
        found = bigrams(line)
        if len(found) <= most and (hit := match.best(found)):
            yield ("line", k, k, *hit)
        kept.append(found if len(found) <= most else None)
    blank = [not _WORD.search(x.lower()) for x in lines]
    start, runs = 0, []
    for k in range(len(lines) + 1):
        if k == len(lines) or blank[k]:
            if k > start:
                runs.append((start, k - 1))
            start = k + 1
    for a, b in runs:
        # Words of a joined unit include those of its lines, so one long line puts the whole out of reach.
        if b > a and all(kept[k] is not None for k in range(a, b + 1)) and len(frozenset().union(*kept[a : b + 1])) <= most:
            if hit := match.best(bigrams(b"\n".join(lines[a : b + 1]))):
                yield ("paragraph", a, b, *hit)
    if len(runs) > 1 and all(x is not None for x in kept) and len(frozenset().union(*kept)) <= most:
        if hit := match.best(bigrams(raw)):
            yield ("text", 0, len(lines) - 1, *hit)


def per_document(
    docs: DataFrame, anywhere: bool = False, templates: dict[str, str] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_matches, best_template, dice, licenses of every row: how many of its units match (with `anywhere`: stretches of
    words), which template best, how well, and all its licences in order.

    A row is summed up where it is scanned, so rows with equal or null ids have each their own matches. Null and empty texts have
    none; other columns are not read. No rows give no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    table = (VARIANTS if anywhere else TEMPLATES) if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Windows(table, percent) if anywhere else Matcher(table, percent)
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                count, best, dice, every = [], [], [], []
                for text in arrow.texts(part, "text"):
                    raw = text.encode()
                    found = [x[-3:] for x in (match.best(raw) if anywhere else units(raw, match))]
                    first = min(((-2.0 * shared / total, name) for name, shared, total in found), default=(0.0, None))
                    count.append(len(found))
                    best.append(first[1])
                    dice.append(-first[0])
                    every.append(",".join(sorted({name.partition("/")[0] for name, _, _ in found})))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(best, pa.string()), pa.array(dice, pa.float64()), pa.array(every, pa.string())],
                    ["doc_id", "n_matches", "best_template", "dice", "licenses"],
                )

    schema = f"doc_id {kind}, n_matches bigint, best_template string, dice double, licenses string"
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(arrow.tidy(run), schema)
    return out.withColumn("dice", F.round("dice", 6))
