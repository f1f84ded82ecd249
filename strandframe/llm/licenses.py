"""License scans by patience alignment.

In a window around a telling word of a template, words that stand once in the window and once in the
template are anchors; the longest increasing run of anchors is kept, and the gaps between them are
aligned the same way. As a window may hold more than one copy, the telling word is also taken as the
anchor, between its neighbouring occurrences. The share of the template's words that are aligned is its coverage;
version numbers must be among them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame

from strandframe.llm.common import per_text

_GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_LIBRARY_HEADER = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_GPL_NOTICE = "This work is licensed under the GNU {0}, version {1}."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_CC = "This work is licensed under a Creative Commons {} License."
_CC_CODE = "you accept and agree to be bound by the terms and conditions of this Creative Commons {} Public License"

#: Notices by which a text says under which license it stands, and license texts and standard headers.
#: Neighbouring versions and kinds stand here too, so that a text is not taken for the license next to its own.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", _MIT),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE),
    "GPL-3.0": (_GPL_NOTICE.format("General Public License", 3), _GNU_HEADER.format("General Public License", 3)),
    "GPL-2.0": (_GPL_NOTICE.format("General Public License", 2), _GNU_HEADER.format("General Public License", 2)),
    "LGPL-3.0": (_GPL_NOTICE.format("Lesser General Public License", 3), _GNU_HEADER.format("Lesser General Public License", 3), _LIBRARY_HEADER.format(3)),
    "LGPL-2.1": (_GPL_NOTICE.format("Lesser General Public License", 2.1), _LIBRARY_HEADER.format(2.1)),
    "AGPL-3.0": (_GPL_NOTICE.format("Affero General Public License", 3), _GNU_HEADER.format("Affero General Public License", 3)),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", _BSD_TWO + _BSD_THIRD + _BSD_END),
    "BSD-2-Clause": (_BSD_TWO + _BSD_END,),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
} | {
    f"CC-{short}-{version}": (f"Licensed under CC {short} {version}.", _CC.format(f"{name} {version} {scope}"), *([_CC_CODE.format(f"{name} {version} {scope}")] if version == "4.0" else []))
    for short, name in (
        ("BY-NC", "Attribution-NonCommercial"), ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"),
        ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
    for version, scope in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic"))
}
#: Short tags name a license by its identifier; all their words must stand.
TEMPLATES = {name: (*texts, f"SPDX-License-Identifier: {name}") for name, texts in TEMPLATES.items()}
LEAST_COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)?")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word in lower case, start, end)."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Indexes of one longest strictly increasing run, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[k], top_at[k] = v, i
        back[i] = top_at[k - 1] if k else -1
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Places of aligned equal words of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        kept = [pairs[k] for k in longest_increasing([p[1] for p in pairs])]
        if not kept:
            continue
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        out += kept
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


@dataclass
class Match:
    license: str
    coverage: float
    start: int
    end: int


class LicenseScanner:
    def __init__(self, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, least_coverage: float = LEAST_COVERAGE):
        self.least = least_coverage
        #: By license and number of the text.
        self.words = {(name, k): [w for w, *_ in words_of(t)] for name, texts in templates.items() for k, t in enumerate([texts] if isinstance(texts, str) else texts)}
        held = Counter(w for ws in self.words.values() for w in set(ws))
        #: Places of a template that must be aligned: versions, as another version is another license, and whole tags.
        self.needed = {key: {j for j, w in enumerate(ws) if ws[0] == "spdx" or any(c.isdigit() for c in w)} for key, ws in self.words.items()}
        #: The words of a template that the fewest templates hold; of these the longest comes first. With coverage c at most n - ceil(cn) words may miss, so of one word more at least one must stand in the text.
        self.telling: dict[tuple[str, int], set[str]] = {}
        for key, ws in self.words.items():
            need = len(ws) - ceil(least_coverage * len(ws) - 1e-9) + 1
            self.telling[key] = set(sorted(set(ws), key=lambda w: (held[w], -len(w), w))[:need])

    def _aligned(self, words: Sequence[str], key: tuple[str, int], i: int, low: int, at: Mapping[str, list[int]]) -> list[tuple[int, int]]:
        """Places of the text and of the template that are aligned, the trigger at place i among them; empty if they are too few. A window may hold copies of the notice, so it is also cut where the trigger stands more often than in one copy."""
        template, w = self.words[key], words[i]
        size = len(template) + max(2, len(template) // 4)
        low, high = max(low, i - size), min(len(words), i + size)
        least = self.least * len(template) - 1e-9
        held = set(words[low:high])
        if sum(t in held for t in template) < least:
            return []
        places, k = at[w], bisect_left(at[w], i)
        own = [j for j, t in enumerate(template) if t == w]
        tries = []
        whole = [(low + x, y) for x, y in align(words[low:high], template)]
        if any(x == i for x, _ in whole):
            tries.append(whole)
        for t, j in enumerate(own):
            before, after = k - t - 1, k + len(own) - t
            first = max(low, places[before] + 1) if before >= 0 else low
            last = min(high, places[after]) if after < len(places) else high
            left = [(first + x, y) for x, y in align(words[first:i], template[:j])]
            right = [(i + 1 + x, j + 1 + y) for x, y in align(words[i + 1 : last], template[j + 1 :])]
            tries.append([*left, (i, j), *right])
        needed = self.needed[key]
        tries = [m for m in tries if len(m) >= least and m[-1][0] - m[0][0] < 2 * len(template) and needed <= {j for _, j in m}]
        return max(tries, key=lambda m: (len(m), m[0][0] - m[-1][0]), default=[])

    def scan(self, text: str | None) -> list[Match]:
        """All matches by start; of overlapping ones the one with the most aligned words, then the highest coverage."""
        if not text:
            return []
        held = set(_WORD.findall(text.lower()))
        # a text that lacks all telling words, or too many words at all, holds no match
        keys = [k for k, telling in self.telling.items() if not telling.isdisjoint(held)]
        keys = [k for k in keys if sum(w in held for w in self.words[k]) >= self.least * len(self.words[k]) - 1e-9]
        if not keys:
            return []
        by_word: dict[str, list[tuple[str, int]]] = {}
        for key in keys:
            for w in self.telling[key]:
                by_word.setdefault(w, []).append(key)
        tokens = words_of(text)
        words = [t[0] for t in tokens]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in by_word:
                at.setdefault(w, []).append(i)
        done: dict[tuple[str, int], int] = {}
        found: list[tuple[Match, int]] = []
        for i in sorted(i for places in at.values() for i in places):
            for key in by_word[words[i]]:
                if i < done.get(key, 0):
                    continue
                match = self._aligned(words, key, i, done.get(key, 0), at)
                if match:
                    first, last = match[0][0], match[-1][0]
                    found.append((Match(key[0], len(match) / len(self.words[key]), tokens[first][1], tokens[last][2]), len(match)))
                    done[key] = last + 1
        out: list[Match] = []
        for m, _ in sorted(found, key=lambda x: (-x[1], -x[0].coverage, x[0].start, x[0].license)):
            if all(m.end <= o.start or o.end <= m.start for o in out):
                out.append(m)
        return sorted(out, key=lambda m: m.start)


def scan_licenses(docs: DataFrame, *, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, least_coverage: float = LEAST_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, license (of the match with the highest coverage, the first of equals; null if none), coverage (0 if none), n_matches, spans (license:start:end, comma-joined; code points).

    Null and empty texts have no license. A text of any length is scanned whole. Repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty result.
    """
    templates = dict(templates)

    def make() -> Callable:
        scanner = LicenseScanner(templates, least_coverage)

        def work(texts: Sequence[str | None]) -> dict[str, list]:
            found = [scanner.scan(t) for t in texts]
            best = [max(f, key=lambda m: (m.coverage, -m.start)) if f else None for f in found]
            return {
                "license": [b.license if b else None for b in best],
                "coverage": [b.coverage if b else 0.0 for b in best],
                "n_matches": [len(f) for f in found],
                "spans": [",".join(f"{m.license}:{m.start}:{m.end}" for m in f) for f in found],
            }

        return work

    return per_text(docs, make, "license string, coverage double, n_matches long, spans string", id_col=id_col, text_col=text_col)
