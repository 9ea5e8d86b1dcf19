"""Licence scans: normalised text against licence templates by Dice coefficient of word bigrams.

Text is lower-cased (A-Z), everything but letters, digits and non-ASCII bytes separates
words.  A template with b bigrams can only reach the threshold d against between
b*d/(2-d) and b*(2-d)/d bigrams: every window of such a length is a candidate, the whole
text among them.  Windows with the highest Dice begin and end at a hit of the template, so
those are compared, from the hits whose running counts allow the threshold; a template with
too few hits in the whole text is never compared.  Dice counts repeated bigrams.

Defined results: null, empty and one-word texts have no bigrams and no licence; of
overlapping windows the better one stays (higher Dice, then longer, then first by name, then
the earlier), so a find leaves out foreign words around it;
repeated rows repeat their result; other columns are ignored.  Rows are independent: one pass,
no shuffle, memory bounded by the largest text.
"""

from __future__ import annotations

import bisect
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrow import map_texts
from stratafold.llm.shingles import mix, word_hashes

THRESHOLD = 0.8
#: Windows compared at once, and room for rounding in bounds.
CELLS, SLACK = 500_000, 1e-9

# Public licence texts and the usual notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        'notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in '
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        'permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
        "one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
}

_SPACE = np.ones(256, bool)
_SPACE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def bigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the bigrams of all texts in order, and their number by text."""
    words, counts = word_hashes(texts, _SPACE)
    if len(words) < 2:
        return np.zeros(0, np.uint64), np.maximum(counts - 1, 0)
    both = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + (words[1:] ^ np.uint64(0xD1342543DE82EF95)))
    ends = np.cumsum(counts)
    inside = np.ones(len(both), bool)
    inside[ends[(ends > 0) & (ends < len(words))] - 1] = False
    return both[inside], np.maximum(counts - 1, 0)


class Templates:
    """Bigrams of all templates: a number for each distinct one, and by template how often it has each."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        grams, counts = bigrams([templates[n] for n in self.names])
        self.known, number = np.unique(grams, return_inverse=True)
        self.sizes = counts
        self.counts = np.zeros((len(self.names), len(self.known) + 1), np.int64)
        np.add.at(self.counts, (np.repeat(np.arange(len(counts)), counts), number), 1)

    def numbers(self, grams: np.ndarray) -> np.ndarray:
        """Number of each bigram; the last number for one of no template."""
        if not len(self.known):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[at] == grams, at, len(self.known))

    def dice(self, template: int, numbers: np.ndarray) -> float:
        mine, total = self.counts[template], len(numbers) + self.sizes[template]
        have = np.bincount(numbers, minlength=len(mine))
        return 2 * float(np.minimum(have, mine)[:-1].sum()) / total if total else 0.0


@lru_cache(maxsize=4)
def _known(items: tuple) -> Templates:
    return Templates(dict(items))


def _ends(at: np.ndarray, back: np.ndarray, size: int, starts: np.ndarray, most: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest Dice of the windows that begin at each of the hits ``starts`` and end before ``before``, and the longest length that has it."""
    width = int((np.searchsorted(at, at[starts] + most) - starts).max())
    values, lengths = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    rows = max(1, CELLS // width)
    for low in range(0, len(starts), rows):
        i = starts[low : low + rows, None]
        j = np.minimum(i + np.arange(width), len(at) - 1)
        length = at[j] - at[i] + 1
        inside = (i + np.arange(width) < len(at)) & (length <= most) & (at[j] < before)
        value = np.where(inside, 2 * np.cumsum(back[j] < at[i], axis=1) / (size + length), 0.0)
        best = width - 1 - np.argmax(value[:, ::-1], axis=1)
        each = np.arange(len(best))
        values[low : low + rows], lengths[low : low + rows] = value[each, best], length[each, best]
    return values, lengths


def found(numbers: np.ndarray, templates: Templates, threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """Licences of one text: name, Dice, first word and end (exclusive) of the match."""
    hit = np.flatnonzero(numbers < len(templates.known))
    if not len(hit):
        return []
    mine = templates.counts[:, numbers[hit]] > 0
    heap: list[tuple[float, int, str, int, int, int]] = []
    parts = {}
    for k in np.flatnonzero(mine.sum(axis=1) * (2 - threshold) >= threshold * templates.sizes - SLACK).tolist():
        size, at = int(templates.sizes[k]), hit[mine[k]]
        # Hits from i to j are enough for the threshold where 2j - d*at[j] is so much more than 2i - d*at[i].
        gain = 2 * np.arange(len(at)) - threshold * at
        starts = np.flatnonzero(np.maximum.accumulate(gain[::-1])[::-1] - gain >= threshold * (size + 1) - 2 - SLACK)
        if not len(starts):
            continue
        grams = numbers[at]
        order = np.argsort(grams, kind="stable")
        earlier = np.arange(len(at)) - templates.counts[k][grams[order]]
        same = (earlier >= 0) & (grams[order[np.maximum(earlier, 0)]] == grams[order])
        back = np.empty(len(at), np.int64)  # a hit counts in windows that begin after this place: the template has no more of its bigram
        back[order] = np.where(same, at[order[np.maximum(earlier, 0)]], -1)
        parts[k] = at, back, size, int(size * (2 - threshold) / threshold + SLACK)
        values, lengths = _ends(at, back, size, starts, parts[k][3], len(numbers))
        for i, value, length in zip(starts.tolist(), values.tolist(), lengths.tolist(), strict=True):
            if value >= threshold:
                heap.append((-value, -length, templates.names[k], int(at[i]), k, i))
    heapq.heapify(heap)
    chosen: list[tuple[int, int, str, float]] = []
    while heap:
        value, length, name, start, k, i = heapq.heappop(heap)
        after = bisect.bisect_left(chosen, (start + 1,))
        if after and chosen[after - 1][1] > start:
            continue
        free = chosen[after][0] if after < len(chosen) else len(numbers) + 1
        if start - length + 1 <= free:
            chosen.insert(after, (start, start - length + 1, name, -value))
            continue
        at, back, size, most = parts[k]
        values, lengths = _ends(at, back, size, np.array([i]), most, free - 1)
        if values[0] >= threshold:
            heapq.heappush(heap, (-float(values[0]), -int(lengths[0]), name, start, k, i))
    return [(name, value, start, end) for start, end, name, value in chosen]


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and licences, an array of (name, dice, start, end) in words."""
    items = tuple(sorted((templates or TEMPLATES).items()))
    kind = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(texts: list) -> tuple[None, list[pa.Array]]:
        known = _known(items)
        grams, counts = bigrams(texts)
        numbers, ends = known.numbers(grams), np.cumsum(counts)
        rows = [[dict(zip(("name", "dice", "start", "end"), m, strict=True)) for m in found(numbers[e - c : e], known, threshold)] for e, c in zip(ends, counts, strict=True)]
        return None, [pa.array(rows, kind)]

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(chosen, scanned, "licences array<struct<name: string, dice: double, start: bigint, end: bigint>>")


def license_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licences, licence and dice of the best match (null if none), all matches as text."""
    rows = license_spans(docs, threshold=threshold)
    best = F.array_max(F.transform("licences", lambda m: F.struct(m["dice"].alias("dice"), (-m["start"]).alias("order"), m["name"].alias("name"))))
    spans = F.array_join(F.transform("licences", lambda m: F.concat_ws(":", m["name"], m["start"], m["end"])), ",")
    return rows.select("doc_id", F.size("licences").cast("bigint").alias("n_licences"), best["name"].alias("licence"), best["dice"].alias("dice"), spans.alias("spans"))
