"""License scans by conditional compression.

Passages that share word sequences with a template are candidate blocks. Each is compressed alone and with every template
as a raw zstandard dictionary; the template that shrinks it most wins. A winner is confirmed by its exact wording: the
words in which the candidate differs from the closest sentence or whole notice of the template.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from difflib import SequenceMatcher
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from galleria.llm.common import map_batches, texts_of

#: The wording of public licenses' notices. A notice is a text of one or more sentences. Other templates can
#: be passed in.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "You may not use this file except in compliance with the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "The author has waived all copyright and related rights to this work."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": ("All rights reserved.", "No part of this work may be reproduced without written permission."),
}

#: A passage is a candidate if it has so many neighbouring words in common with a template (all of a shorter notice).
GRAM = 3
#: Common words with at most so many other words between them belong to one block.
GAP = 6
#: A winner is confirmed from this likeness of wording on: 2 * words in common / words of both.
LIKENESS = 0.75
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
SENTENCE_END = re.compile(r"[.!?;]+(?=\s)|\n\s*\n")
#: Judged blocks that a worker remembers.
REMEMBERED = 50_000

FOUND = "doc_id long, at long, block string, license string, reduction double, runner_up string, margin double, likeness double, differences array<string>, confirmed boolean"
NAMES = [c.split()[0] for c in FOUND.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.bool_()]
Templates = tuple[tuple[str, tuple[str, ...]], ...]


def lower(text: str) -> str:
    """Lower case, each character for itself, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=8)
def wordings(templates: Templates) -> dict[str, list[list[str]]]:
    """The words of each notice of a template, and of each of its sentences."""
    found = {}
    for name, notices in templates:
        parts = [p for n in notices for p in (n, *SENTENCE_END.split(n))]
        found[name] = [w for w in dict.fromkeys(tuple(WORD.findall(lower(p))) for p in parts) if w]
    return {name: [list(w) for w in parts] for name, parts in found.items()}


@lru_cache(maxsize=8)
def grams(templates: Templates) -> ahocorasick.Automaton:
    """Finds the word sequences of the templates, each between spaces; its value is the number of words."""
    automaton = ahocorasick.Automaton()
    for parts in wordings(templates).values():
        for words in parts:
            for i in range(max(1, len(words) - GRAM + 1)):
                some = words[i : i + GRAM]
                if len(some) > 1:
                    automaton.add_word(f" {' '.join(some)} ", len(some))
    automaton.make_automaton()
    return automaton


def plain_form(text: str) -> bytes:
    """Lower case with single spaces, so that case and line breaks don't count."""
    return " ".join(lower(text).split()).encode("utf-8", "surrogatepass")


@lru_cache(maxsize=8)
def compressors(templates: Templates) -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    """The plain compressor and those that know a template."""
    options = {"level": 9, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    known = {name: zstandard.ZstdCompressionDict(b"\n".join(map(plain_form, text)), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for name, text in templates}
    return zstandard.ZstdCompressor(**options), {name: zstandard.ZstdCompressor(dict_data=d, **options) for name, d in known.items()}


def ranked(block: str, templates: Templates) -> list[tuple[float, str]]:
    """Reduction of the compressed size by each template, the largest first, ties by name."""
    plain, known = compressors(templates)
    data = plain_form(block)
    alone = len(plain.compress(data))
    return sorted(((1 - len(c.compress(data)) / alone, name) for name, c in known.items()), key=lambda x: (-x[0], x[1]))


def differences(block: str, parts: list[list[str]]) -> tuple[float, list[str]]:
    """Likeness to the closest of some wordings, and the words that differ: -gone +added."""
    own, best = WORD.findall(lower(block)), (-1.0, [])
    match = SequenceMatcher(None, autojunk=False)
    match.set_seq2(own)
    for words in parts:
        match.set_seq1(words)
        if match.real_quick_ratio() > best[0] and match.quick_ratio() > best[0] and match.ratio() > best[0]:
            changes = [f"{mark}{w}" for op, a, b, c, d in match.get_opcodes() if op != "equal" for mark, ws in (("-", words[a:b]), ("+", own[c:d])) for w in ws]
            best = match.ratio(), changes
    return best


@lru_cache(maxsize=REMEMBERED)
def judged(block: str, templates: Templates) -> tuple:
    """The block with its license, reduction, runner-up, margin, likeness, differences, and whether it is confirmed."""
    order = ranked(block, templates)
    told = {name: differences(block, wordings(templates)[name]) for x, name in order if x == order[0][0]}
    name = min(told, key=lambda n: (-told[n][0], n))  # sizes are whole bytes: of equal winners the wording tells
    (likeness, changes), first = told[name], order[0][0]
    second, other = next(((x, n) for x, n in order if n != name), (0.0, None))
    return block, name, first, other, first - second, likeness, changes, likeness >= LIKENESS


def shared_runs(text: str, templates: Templates) -> list[list[tuple[int, int]]]:
    """Runs of words that a text shares with the templates, as the places (code points) of their unbroken pieces.

    A run ends where more than GAP other words follow, or at the end of a sentence.
    """
    low = lower(text)
    words = WORD.findall(low)
    joined = f" {' '.join(words)} "
    hits = [(end, n) for end, n in grams(templates).iter(joined)]
    if not hits:
        return []
    stops, at = [], 0
    for w in words:
        at += len(w) + 1
        stops.append(at)
    places = [m.span() for m in WORD.finditer(low)]
    ends = [m.start() for m in SENTENCE_END.finditer(low)]
    common = sorted({i for end, n in hits for last in (bisect_right(stops, end - 1),) for i in range(last - n + 1, last + 1)})
    runs, before = [], None
    for i in common:
        if before is None or i - before > GAP + 1 or bisect_right(ends, places[before][0]) != bisect_right(ends, places[i][0]):
            runs.append([places[i]])
        elif i == before + 1:
            runs[-1][-1] = (runs[-1][-1][0], places[i][1])
        else:
            runs[-1].append(places[i])
        before = i
    return runs


def blocks(text: str, templates: Templates) -> list[tuple[int, tuple]]:
    """Candidate blocks as (start, judgement), the most likely form of each.

    A run of shared words is judged as it stands, without pieces at its ends, and extended to the ends of its sentence, with
    and without those of its line. Neighbouring runs together are judged as a whole notice, which is taken if it is
    confirmed.
    """

    pieces = shared_runs(text, templates)
    marks = [m.span() for m in SENTENCE_END.finditer(text)] if pieces else []
    begins, ends = [a for a, _ in marks], [b for _, b in marks]

    def sentence(a: int, b: int) -> tuple[int, int]:
        before, after = bisect_right(ends, a), bisect_left(begins, b)
        return ends[before - 1] if before else 0, begins[after] + 1 if after < len(begins) else len(text)

    def best(spans: list[tuple[int, int]]) -> tuple[int, tuple]:
        forms = {(a + len(x) - len(x.lstrip()), x.strip()): None for a, b in spans if (x := text[a:b]).strip()}
        return max(((a, judged(x, templates)) for a, x in forms), key=lambda f: (f[1][5], -len(f[1][0])))

    runs, single = [(p[0][0], p[-1][1]) for p in pieces], []
    for (a, b), p in zip(runs, pieces, strict=True):
        c, d = sentence(a, b)
        line = (text.rfind("\n", 0, a) + 1, len(text) if (e := text.find("\n", b)) < 0 else e)
        shorter = [(x[0], b) for x in p[1:]] + [(a, x[1]) for x in p[:-1]] + [(x[0], y[1]) for x, y in zip(p[1:], p[1:-1], strict=False)]
        single.append(best([(a, b), *shorter, (c, d), (max(c, line[0]), min(d, line[1]))]))
    found, i = [], 0
    while i < len(runs):
        j = i + 1  # runs with no more than GAP words between them may be one notice
        while j < len(runs) and len(WORD.findall(text[runs[j - 1][1] : runs[j][0]])) <= GAP:
            j += 1
        whole = best([(runs[i][0], runs[j - 1][1]), (runs[i][0], sentence(*runs[j - 1])[1])]) if j - i > 1 else None
        found += [whole] if whole and whole[1][-1] else single[i:j]
        i = j
    return found


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Candidate blocks of every document with the template that explains them best.

    docs: doc_id, text, further columns are left out. Returns FOUND: doc_id, at (number of the line in which the block
    begins), the block, the winning license with its reduction of the compressed size, the runner-up, the margin between
    them, likeness and differing words of the wording, and whether it is confirmed. Any sentence of any template, wrapped
    over lines or in the middle of other words, is a candidate; there is no list of cue words.

    Rows are mapped one by one, without a shuffle; equal blocks are judged once in a worker. Null and empty texts have no
    blocks; repeated rows have the same blocks each; rows with a null doc_id are kept as such; ties go to the name that
    comes first; no rows give no rows; texts may have any length.
    """
    fixed = tuple(sorted(templates.items()))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            own = blocks(text, fixed)
            breaks = [i for i, c in enumerate(text) if c == "\n"] if own else []
            found += [(doc_id, bisect_left(breaks, start), *judgement) for start, judgement in own]
        columns = list(zip(*found, strict=True)) or [[]] * len(TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    return map_batches(docs.select("doc_id", F.col("text")), rows, FOUND)
