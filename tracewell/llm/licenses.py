"""Licence scan: texts, their lines and all windows of their words against licence templates, by Dice coefficient over word bigrams.

Both sides are normalised alike: case, punctuation, years and copyright lines do not count, some spellings are
made one. A unit (the whole text, and each line of it) is compared with a template only if its number of bigrams allows
the threshold (Dice >= t needs a size ratio of at least t / (2 - t)) and if it has one of the template's few bigrams of which
every unit that reaches the threshold has at least one. Both prunings are exact.

Passages are windows of the word stream, wherever they begin and end: licences wrapped over lines, or within other text. A
window can reach the threshold only where enough of the template's bigrams lie within its largest size; around these places every window that begins
and ends with one of them is measured (any other window is less similar than one of these). Per beginning the most similar end counts. Of windows
that share half of their matched bigrams the one with the larger matched number times Dice stays; one that only repeats a unit's
licence within that unit's lines is not listed again.

Covered are TEMPLATES (short notices, headers and short licences) and the full texts in `license_texts`; nothing else is named. Not
covered are other versions and kinds, among them the full text of AGPL-3.0, BSD-4-Clause, MIT-0, 0BSD and CC texts but CC0. Where siblings are alike
beyond the threshold, a licence is named only if the words that tell it apart (MARKS) are there, and those of its sibling are not; else the
place is left unnamed. `Scanner.scan` compares by Dice alone.

Null and empty texts match nothing. Repeated rows are scanned each; of equally similar templates the first by name
counts. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.text import slices

THRESHOLD = 0.9

GNU = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software
Foundation{2} either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}
for more details. You should have received a copy of the GNU {1} along with this program. If not, see https://www.gnu.org/licenses/."""

# Licence texts and notices, as they are published.
TEMPLATES = {
    "AGPL-3.0 (header)": GNU.format(":", "Affero General Public License", ",", "3"),
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED
BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC0-1.0 (notice)": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain
Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.""",
    "GPL-2.0 (header)": GNU.format(";", "General Public License", ";", "2"),
    "GPL-2.0 (header, by post)": GNU.format(";", "General Public License", ";", "2").replace(
        "If not, see https://www.gnu.org/licenses/.",
        "If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "LGPL-2.1 (header)": GNU.format(";", "Lesser General Public License", ";", "2.1").replace("program", "library"),
    "LGPL-3.0 (header)": GNU.format(":", "Lesser General Public License", ",", "3"),
    "MPL-2.0 (notice)": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (header)": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along
with this program. If not, see https://www.gnu.org/licenses/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": "Released under the MIT License.",
    "MIT (text)": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}


def full_texts() -> dict[str, str]:
    """The terms of longer licences, without what follows on how to apply them."""
    return {f"{p.stem} (full text)": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


#: Phrases, normalised, that tell a template from its siblings: those that must be there, and those that must not.
MARKS: dict[str, tuple[tuple[bytes, ...], tuple[bytes, ...]]] = {
    "AGPL-3.0 (header)": ((b"affero", b"version 3"), ()),
    "Apache-2.0": ((b"apache license", b"version 2.0"), ()),
    "Apache-2.0 (header)": ((b"apache license", b"version 2.0"), ()),
    "BSD-2-Clause": ((), (b"endorse", b"promote", b"advertising")),
    "BSD-3-Clause": ((b"endorse or promote",), (b"advertising",)),
    "CC-BY-4.0 (notice)": ((b"attribution 4.0",), ()),
    "CC-BY-NC-4.0 (notice)": ((b"attribution nc 4.0",), ()),
    "CC-BY-SA-4.0 (notice)": ((b"attribution sa 4.0",), ()),
    "GPL-2.0": ((b"version 2",), (b"affero", b"lesser", b"library")),
    "GPL-2.0 (full text)": ((b"version 2",), (b"affero",)),
    "GPL-2.0 (header)": ((b"version 2",), (b"affero", b"lesser", b"library general")),
    "GPL-2.0 (header, by post)": ((b"version 2",), (b"affero", b"lesser", b"library general")),
    "GPL-3.0": ((b"version 3",), (b"affero", b"lesser", b"library")),
    "GPL-3.0 (full text)": ((b"version 3",), (b"remote network",)),
    "GPL-3.0 (header)": ((b"version 3",), (b"affero", b"lesser", b"library general")),
    "ISC": ((b"provided that",), ()),
    "LGPL-2.1 (full text)": ((b"lesser general",), (b"library general",)),
    "LGPL-2.1 (header)": ((b"lesser", b"version 2.1"), ()),
    "LGPL-3.0 (full text)": ((b"lesser general", b"version 3"), ()),
    "LGPL-3.0 (header)": ((b"lesser", b"version 3"), ()),
    "MIT (text)": ((b"notice shall be",), ()),
    "MPL-2.0 (notice)": ((b"mozilla", b"2.0"), ()),
}


def named(name: str, found: list[bytes]) -> bool:
    """Whether the words have the marks of the template."""
    must, never = MARKS.get(name, ((), ()))
    text = b" %s " % b" ".join(found)
    return all(b" %s " % m in text for m in must) and not any(b" %s " % m in text for m in never)


# Spellings that count as one.
SAME_WORDS = {b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed", b"noncommercial": b"nc", b"sharealike": b"sa"}

#: Letters, digits and dots between digits stay; the rest separates.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 46 else 32 for c in range(256))
#: Of wrapped licences, lines that only happen to begin with the word stay.
COPYRIGHT = re.compile(rb"^[^\w\n]*(?:copyright(?![ \t]+(?:notices?|holders?|owners?|licen[cs]e|laws?|and|or)\b)|\(c\)|\xc2\xa9)[ \t].*$", re.I | re.M)

Bigram = tuple[bytes, bytes]


def words(text: bytes) -> list[bytes]:
    """Normalised words; dots at the ends of words go."""
    found = [w.strip(b".") if b"." in w else w for w in text.translate(NORMAL).split()]
    return [SAME_WORDS.get(w, w) for w in found if w]


def bigrams(found: list[bytes]) -> Counter[Bigram]:
    """Word pairs with their counts; a single word is paired with nothing."""
    return Counter(zip(found, found[1:])) if len(found) > 1 else Counter([(w, b"") for w in found])


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.templates = [(name, bigrams(words(COPYRIGHT.sub(b"", text.encode())))) for name, text in sorted(templates.items())]
        self.sizes = [sum(b.values()) for _, b in self.templates]
        self.least = min(self._bounds(s)[0] for s in self.sizes)
        self.most = max(self._bounds(s)[1] for s in self.sizes)
        common = Counter(b for _, bag in self.templates for b in bag)
        self.cues: dict[Bigram, list[int]] = {}
        for k, (_, bag) in enumerate(self.templates):
            # a unit at the threshold shares so many; without any of the others' number plus one it cannot
            shared = int(-(-threshold * (self.sizes[k] + self._bounds(self.sizes[k])[0]) // 2))
            left = self.sizes[k] - max(shared, 1) + 1
            for b in sorted(bag, key=lambda b: (common[b], bag[b], b)):
                if left <= 0:
                    break
                self.cues.setdefault(b, []).append(k)
                left -= bag[b]
        self.cue_words = frozenset(a for a, _ in self.cues)
        self.numbers = {b: i for i, b in enumerate(common)}
        self.caps = np.zeros((len(self.templates), len(common)), np.int32)  # how often a template has a bigram
        for k, (_, bag) in enumerate(self.templates):
            for b, n in bag.items():
                self.caps[k, self.numbers[b]] = n
        self.single = {a: self.numbers[a, b] for a, b in self.numbers if not b}

    def _bounds(self, size: int) -> tuple[int, int]:
        t = self.threshold
        return int(-(-size * t / (2 - t) // 1)), int(size * (2 - t) / t)

    def compare(self, found: list[bytes]) -> list[tuple[float, str]]:
        """(Dice, template) of all templates that the words reach."""
        size = max(len(found) - 1, min(len(found), 1))
        if not self.least <= size <= self.most or self.cue_words.isdisjoint(found):
            return []
        own = bigrams(found)
        out = []
        for k in {k for b in own.keys() & self.cues.keys() for k in self.cues[b]}:
            low, high = self._bounds(self.sizes[k])
            if low <= size <= high:
                bag = self.templates[k][1]
                dice = 2 * sum(min(n, bag[b]) for b, n in own.items()) / (size + self.sizes[k])
                if dice >= self.threshold:
                    out.append((dice, self.templates[k][0]))
        return out

    def scan(self, text: bytes, marked: bool = False) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first line, lines) of the best template per unit, if `marked` of those whose marks are there; the whole text before its lines."""
        units = [(0, text.count(b"\n") + 1, COPYRIGHT.sub(b"", text) if b"opyright" in text or b"OPYRIGHT" in text or b"(c)" in text or b"\xc2\xa9" in text else text)]
        if units[0][1] > 1:
            units += [(i, 1, line) for i, line in enumerate(text.split(b"\n")) if line]
        out = []
        for first, n, unit in units:
            reached = self.compare(found := words(unit))
            if marked:
                reached = [r for r in reached if named(r[1], found)]
            if reached:
                dice, name = min(reached, key=lambda r: (-r[0], r[1]))
                out.append((name, dice, first, n))
        return out

    def windows(self, found: list[bytes]) -> list[tuple[float, float, int, int, int, np.ndarray]]:
        """(matched * Dice, Dice, template, first bigram, bigrams, places of the template's bigrams) of the best window per template and beginning."""
        if self.cue_words.isdisjoint(found):
            return []
        hits = [(i, v) for i, v in enumerate(map(self.numbers.get, zip(found, found[1:]))) if v is not None]
        if not self.single.keys().isdisjoint(found):
            hits = sorted(hits + [(i, self.single[w]) for i, w in enumerate(found) if w in self.single])
        if not hits:
            return []
        places, kinds = np.array(hits, np.int64).T
        out = []
        for k, size in enumerate(self.sizes):
            low, high = self._bounds(size)
            need = max(1, int(-(-self.threshold * (size + low) // 2)))
            mine = self.caps[k][kinds] > 0
            at, own = places[mine], kinds[mine]
            if len(at) < need:
                continue
            begins = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < high)
            if not len(begins):
                continue
            # a bigram counts in a window that has fewer than its number in the template before it: one that begins after `full`
            order = np.lexsort((at, own))
            full = np.full(len(at), -1)
            cap = self.caps[k][own[order]]
            back = np.arange(len(at)) - cap
            same = (back >= 0) & (own[order][np.maximum(back, 0)] == own[order])
            full[order[same]] = order[back[same]]
            for a in begins.tolist():
                b = int(np.searchsorted(at, at[a] + high))
                sizes = at[a:b] - at[a] + 1
                matched = np.cumsum(full[a:b] < a)
                dice = 2 * matched / (sizes + size)
                e = int(dice.argmax())
                if dice[e] >= self.threshold:
                    out.append((float(matched[e] * dice[e]), float(dice[e]), k, int(at[a]), int(sizes[e]), at[a : a + e + 1]))
        return out

    def passages(self, found: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(template, Dice, first bigram, bigrams) of the windows that stay, in the order of the words."""
        used = np.zeros(len(found), bool)
        out = []
        for _, dice, k, first, n, at in sorted(self.windows(found), key=lambda w: (-w[0], w[2], w[3])):
            if 2 * used[at].sum() < len(at) and named(self.templates[k][0], found[first : first + n + 1]):
                used[at] = True
                out.append((self.templates[k][0], dice, first, n))
        return sorted(out, key=lambda p: (p[2], -p[3], p[0]))

    def find(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """What `scan` finds and marks allow, and after it (template, Dice, first line, lines) of the passages."""
        if self.cue_words.isdisjoint(words(text)):
            return []
        out = self.scan(text, marked=True)
        lines = [words(x) for x in COPYRIGHT.sub(b"", text).split(b"\n")]
        ends = list(accumulate(map(len, lines)))
        found = [w for x in lines for w in x]
        places = [(name, dice, bisect_right(ends, a), bisect_right(ends, min(a + n, len(found) - 1))) for name, dice, a, n in self.passages(found)]
        for m in COPYRIGHT.finditer(text):  # a notice may follow on the copyright line itself
            i = text.count(b"\n", 0, m.start())
            places += [(name, dice, i, i) for name, dice, _, _ in self.passages(words(m[0]))]
        for name, dice, a, b in places:
            if not any(u == name and i <= a and b < i + n for u, _, i, n in out):
                out.append((name, dice, a, b - a + 1))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """By the given templates, or all covered ones, per document: doc_id, license and dice of its best match (null without), matches (template, dice, first line, number of lines)."""
    templates = TEMPLATES | full_texts() if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in slices(batches, "text"):
            rows = [scanner.find((t or "").encode()) for t in batch.column("text").to_pylist()]
            best = [min(r, key=lambda m: (-m[1], m[0])) if r else (None, None) for r in rows]
            found = [[{"license": a, "dice": b, "line": c, "n_lines": d} for a, b, c, d in r] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array(found, matches)],
                names=["doc_id", "license", "dice", "matches"],
            )

    matches = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("line", pa.int32()), ("n_lines", pa.int32())]))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, dice double, matches array<struct<license:string,dice:double,line:int,n_lines:int>>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
