"""License scans by patience alignment.

A template is aligned with a part of a text by anchors: words that occur once in both, of which the
longest increasing subsequence is kept; the gaps between anchors are aligned in the same way (a word may
be unique in a gap), and equal words next to an end of a gap are matched. The share of the template's
words that are matched is its coverage.

Parts are found without loss for the wanted coverage: the text's words, and then a window's, must, counted
without their order, cover the template that far. Each such window is aligned until one holds a part.

Notices are short, so a license's name, version and conditions decide: the telling words in a part must be
those of the template, in their order. Of parts of several templates that overlap, the one with the most matched words
stays (then that of the larger coverage, the shorter, the earlier, the first by name).
"""

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Spellings of a version: 3.0 and v3 are 3.
_VERSION = re.compile(r"(?:\b|(?<=gpl))v\.?\s?(?=\d)|(?<=\d)\.0\b(?!\.\d)")

#: Texts of public licenses, without names and years. Fixed values.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Whole texts that lie beside this module.
FILES = "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"
#: Words that tell one license from another where its notice is short, besides numbers.
TELLING = frozenset("mit isc bsd apache mozilla mpl gnu gpl lgpl agpl lesser library affero creative cc cc0 nc sa nd noncommercial sharealike noderivatives noderivs".split())
#: Words from which on a template is long.
LONG = 512
FOUND = "array<struct<license: string, start: int, end: int, n_matched: int, n_words: int, coverage: double>>"


def notices() -> Iterator[tuple[str, str]]:
    """Names and texts of the short notices, made by rule from names, versions and conditions."""
    for code, name, versions in (("GPL", "GNU General Public License", "2 3"), ("LGPL", "GNU Lesser General Public License", "2.1 3"), ("AGPL", "GNU Affero General Public License", "3"), ("MPL", "Mozilla Public License", "2"), ("Apache", "Apache License", "2")):
        for version in versions.split():
            for text in (f"This work is licensed under the {name}, version {version}.", f"Licensed under the {name}, version {version}.", f"Licensed under the {code} {version}."):
                yield f"{code}-{float(version)} notice", text
    for code, name in (("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause")):
        yield f"{code} notice", f"Released under the {name} License."
        yield f"{code} notice", f"Licensed under the {name} License."
    spelled = {"": "", "NC": "-NonCommercial", "SA": "-ShareAlike", "ND": "-NoDerivatives"}
    for conditions in (("",), ("NC",), ("SA",), ("ND",), ("NC", "SA"), ("NC", "ND")):
        code, name = "-".join(["CC-BY", *filter(None, conditions)]), "".join(spelled[c] for c in conditions)
        for version in ("3.0", "4.0"):
            yield f"{code}-{version} notice", f"Licensed under CC {code[3:]} {version}."
            yield f"{code}-{version} notice", f"This work is licensed under a Creative Commons Attribution{name} {version} International License."
    yield "CC0-1.0 notice", "Released under CC0 1.0 Universal."


def known_templates() -> list[tuple[str, str]]:
    """Name and text of all templates of this module; a name may have several texts."""
    whole = [(name, files(__package__).joinpath("license_texts", f"{name}.txt").read_text("utf-8")) for name in FILES]
    return [*TEXTS.items(), *whole, *notices()]


def words(text: str | None) -> list[str]:
    """Words in lower case; a version's v and .0 are left out."""
    return _WORD.findall(_VERSION.sub(" ", (text or "").lower()))


def telling(tokens: list[str]) -> set[str]:
    return {w for w in tokens if w in TELLING or w.isdecimal()}


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of a and b, rising in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
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
        anchors = [pairs[i] for i in increasing([p[1] for p in pairs])]
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            gaps += [(x[0] + 1, y[0], x[1] + 1, y[1]) for x, y in zip(edges, edges[1:], strict=False)]
    return sorted(out)


@dataclass
class Template:
    name: str
    tokens: list[str]
    least: float

    def __post_init__(self) -> None:
        self.needed = math.ceil(self.least * len(self.tokens) - 1e-9)
        self.width = len(self.tokens) + max(2, len(self.tokens) // 4)
        self.counts = Counter(self.tokens)
        self.long = len(self.tokens) > LONG
        self.tells = telling(self.tokens) if self.name.endswith((" notice", " header")) else None
        self.must: list[str] = []
        missing = 0
        for w in sorted(self.counts, key=lambda w: (-len(w), w)):
            self.must.append(w)
            missing += self.counts[w]
            if missing > len(self.tokens) - self.needed:
                break

    def begins(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Where windows begin whose words may cover the template far enough, and how many they may cover. Windows begin at
        words of the template and are shorter at the text's end."""
        have, covered, out = Counter(), 0, []
        for i in range(len(tokens) + self.width - self.needed):
            if i < len(tokens) and (w := tokens[i]) in self.counts:
                have[w] += 1
                covered += have[w] <= self.counts[w]
            begin = i - self.width + 1
            if begin >= 1 and (old := tokens[begin - 1]) in self.counts:
                covered -= have[old] <= self.counts[old]
                have[old] -= 1
            if covered >= self.needed and begin >= 0 and tokens[begin] in self.counts:
                out.append((begin, covered))
        return out

    def aligned(self, tokens: list[str], begin: int) -> list[tuple[int, int]]:
        """Matched positions of the template and of the text, in the window that begins here."""
        return [(i, begin + j) for i, j in align(self.tokens, tokens[begin : begin + self.width])]

    def holds(self, tokens: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether these are enough and the telling words are right: those between the first and the last, and no number behind."""
        if len(pairs) < self.needed or self.tells is None:
            return len(pairs) >= self.needed
        first, end = pairs[0][1], pairs[-1][1] + 1
        return telling(tokens[first:end]) == self.tells and not (end < len(tokens) and tokens[end].isdecimal())

    def found(self, tokens: list[str]) -> list[tuple]:
        """Parts from the first on: the first window that holds one and those that begin within what the
        template may miss are one part, of which the best (most words, then the shortest) stays; the next begins after it. A last word that lies far behind the others may be
        the next part's: it is left to that part, if there is one.

        Of a long template windows that can't hold enough are passed over: one that begins d words later has at most d more matched words;
        and the first window that holds a part is aligned once more from its first matched word on."""
        parts: list[list[tuple[int, int]]] = []
        begins, n, short = self.begins(tokens), 0, 0
        while n < len(begins):
            begin = begins[n][0]
            best = self.aligned(tokens, begin)
            n += 1
            if not self.holds(tokens, best):
                if self.long:
                    n = bisect_left(begins, (begin + max(1, self.needed - len(best)),), n)
                continue
            if self.long:
                if len(again := self.aligned(tokens, best[0][1])) >= len(best):
                    best = again
            else:
                last = best[min(len(self.tokens) - self.needed, len(best) - 1)][1]
                near = begins[n : bisect_left(begins, (last + 1,), n)]
                for other, most in sorted(near, key=lambda x: (-x[1], x[0])):
                    if most < len(best):
                        break
                    pairs = self.aligned(tokens, other)
                    if (len(pairs), best[-1][1] - best[0][1]) > (len(best), pairs[-1][1] - pairs[0][1] if pairs else 0) and self.holds(tokens, pairs):
                        best = pairs
            if parts and best[0][1] <= parts[-1][-1][1]:
                del parts[-1][short:]
            parts.append(best)
            # of the beginnings with enough words that with the most matched words beyond those between them
            short = max(range(self.needed, len(best) + 1), key=lambda k: (2 * k - best[k - 1][1], k))
            n = bisect_left(begins, (best[short - 1][1] + 1,))
        return [(self.name, p[0][1], p[-1][1] + 1, len(p), len(self.tokens), len(p) / len(self.tokens)) for p in parts]


def best_of(found: list[tuple]) -> list[tuple]:
    """Of parts that overlap the best, in the order of their starts."""
    kept: list[tuple] = []  # by start; they don't overlap
    for f in sorted(found, key=lambda f: (-f[3], -f[5], f[2] - f[1], f[1], f[0])):
        at = bisect_left(kept, f[1], key=lambda k: k[1])
        if (at == 0 or kept[at - 1][2] <= f[1]) and (at == len(kept) or f[2] <= kept[at][1]):
            kept.insert(at, f)
    return kept


class Scanner:
    """The templates with an index of the words of which a text must hold one."""

    def __init__(self, templates: list[Template]) -> None:
        self.templates = templates
        self.by_word: dict[str, list[int]] = {}
        for n, t in enumerate(templates):
            for w in t.must:
                self.by_word.setdefault(w, []).append(n)

    def scan(self, text: str | None) -> list[tuple]:
        """(license, start, end, n_matched, n_words, coverage) of what the whole text holds; start and end count words."""
        met = self.by_word.keys() & set(_WORD.findall((text or "").lower()))
        if not met:
            return []
        tokens = words(text)
        counts = Counter(tokens)
        possible = [self.templates[n] for n in sorted({n for w in met for n in self.by_word[w]})]
        possible = [t for t in possible if (t.tells is None or t.tells <= counts.keys()) and sum(min(n, counts[w]) for w, n in t.counts.items()) >= t.needed]
        return best_of([f for t in possible for f in t.found(tokens)])


def scan_text(text: str | None, templates: list[Template]) -> list[tuple]:
    return Scanner(templates).scan(text)


def with_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8, column: str = "licenses") -> DataFrame:
    """docs with a column added (replacing one of its name). The templates go to the executors: a list of texts, not a table."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner([Template(n, words(t), least) for n, t in templates or known_templates() if words(t)]))

    @F.pandas_udf(FOUND)
    def scanned(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([[dict(zip(("license", "start", "end", "n_matched", "n_words", "coverage"), f, strict=True)) for f in own.scan(t)] for t in texts], dtype=object)

    return docs.withColumn(column, scanned("text"))


def licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, start, end, n_matched, n_words, coverage: a row for each part of each row of docs that covers a
    template to the share `least` or more and no better part overlaps. Null, empty and wordless texts have none; repeated rows are
    reported each; an empty table gives an empty result; columns besides doc_id and text are ignored."""
    rows = with_licenses(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), templates, least)
    return rows.select("doc_id", F.explode("licenses").alias("found")).select("doc_id", "found.*")
