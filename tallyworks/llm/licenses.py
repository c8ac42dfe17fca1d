"""License scans.

Templates are cut into words; of the hashes of their word k-grams winnowing keeps one in each window, in
an inverted index hash -> (template, place). A match that lacks words, or has words between, may hold no
such k-gram. It lacks at most m = (1 - least) of its template's words, so that it holds one of any m + 1 of
them: the m + 1 longest words of each template are fingerprints of one word beside the others. A document's
fingerprints that the index holds pick candidate places; where enough of the words around one are the
template's, banded alignment of the template with the document gives the matched share of the template and
the span in the text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_col
from .neardup import mix

# Public license notices, as their licenses or usual practice word them.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT line": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_word = re.compile(r"[^\W_]+")


def hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as h

    return np.fromiter((h(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def winnow(g: np.ndarray, window: int) -> list[int]:
    """Places of the least hash, the last of equal ones, in each window."""
    kept: set[int] = set()
    for at in range(max(1, len(g) - window + 1)) if len(g) else ():
        part = g[at : at + window]
        kept.add(at + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(kept)


@dataclass
class Index:
    names: list[str]
    words: list[list[str]]
    #: for each size of grams: sorted hashes, and the (template, place) of each
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    places: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)


def build(templates: dict[str, str], least: float, k: int = 3, window: int = 2) -> Index:
    """Inverted index; any match of a share of at least ``least`` of a template's words hits it."""
    index = Index(sorted(templates), [])
    found: dict[int, dict[int, list[tuple[int, int]]]] = {1: defaultdict(list), k: defaultdict(list)}
    for t, name in enumerate(index.names):
        words = _word.findall(templates[name].lower())
        index.words.append(words)
        h = hashes(words)
        if len(words) >= k:
            g = grams(h, k)
            for at in winnow(g, window):
                found[k][int(g[at])].append((t, at))
        lacking = math.floor(len(words) * (1 - least) + 1e-9)
        for at in sorted(range(len(words)), key=lambda i: (-len(words[i]), i))[: lacking + 1]:  # noqa: B023
            found[1][int(h[at])].append((t, at))
    index.places = {n: dict(x) for n, x in found.items()}
    index.keys = {n: np.array(sorted(x), np.uint64) for n, x in found.items()}
    return index


def align(template: list[str], words: list[str], band: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1 place in words): the most words of both in one order, near the diagonal.

    words starts ``band`` places before where the template's first word is expected.
    """
    none = (0, 0, 0)
    row = {j: none for j in range(-1, len(words))}
    for i, t in enumerate(template):
        lo, hi = max(0, i), min(len(words), i + 2 * band + 1)
        new = {lo - 1: row.get(lo - 1, none)}
        for j in range(lo, hi):
            best = max(row.get(j, none), new[j - 1], key=lambda x: (x[0], x[1] - x[2]))
            if words[j] == t:
                n, first, _ = row.get(j - 1, none)
                hit = (n + 1, first if n else j, j + 1)
                if (hit[0], hit[1] - hit[2]) > (best[0], best[1] - best[2]):
                    best = hit
            new[j] = best
        row = new
    return max(row.values(), key=lambda x: (x[0], x[1] - x[2]), default=none)


def places(template: list[str], words: list[str], known: np.ndarray, found: list[tuple[int, int]], band: int, least: float, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(matched words, first, last + 1 place) of a template's matches in words[lo:hi]; none share a word.

    found has sorted (start, place): where the template would start, by the gram at a place. known: how many of
    the words before each place are words of the template, which bounds what an alignment can match.
    """
    need, size = least * len(template), len(template)
    hi = len(words) if hi is None else hi
    failed = None
    for i, (start, place) in enumerate(found):
        if place < lo or start == failed:
            continue  # the gram lies in the last match, or its diagonal was aligned
        a, b = max(lo, start - band), min(hi, start + size + band)
        shift = start - band
        n = first = end = 0
        if a < b and known[b] - known[a] >= need:
            # the band's diagonal starts where the window would have, had it not been cut
            n, first, end = align(template, [""] * (a - shift) + words[a:b], band)
        if not n or n < need:
            failed = start
            continue
        first, end, failed = first + shift, end + shift, None
        before = []
        for x in islice(found, i, None):
            if x[0] > first:
                break
            if lo <= x[1] < first:
                before.append(x)
        yield from places(template, words, known, before, band, least, lo, first)
        yield n, first, end
        lo = end


def matches(text: str, index: Index, band: int, least: float) -> Iterator[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) of a text; start and end count characters."""
    low = text.lower()
    words = _word.findall(low)
    h = hashes(words)
    starts: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for size, keys in index.keys.items():
        g = grams(h, size) if size > 1 else h
        if not len(g) or not len(keys):
            continue
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        for place in np.flatnonzero(keys[at] == g).tolist():
            for t, offset in index.places[size][int(g[place])]:
                starts[t].add((place - offset, place))
    if not starts:
        return
    spans = [m.span() for m in _word.finditer(low)] if len(low) == len(text) else [m.span() for m in _word.finditer(text)]
    if len(spans) != len(words):  # lower-casing changed where words end
        spans = None
    met: list[tuple[int, int, int, int]] = []
    for t, found in sorted(starts.items()):
        template = index.words[t]
        known = np.r_[0, np.cumsum(np.isin(h, hashes(template)))]
        near = np.array(sorted(found))
        lo, hi = (np.clip(near[:, 0] + x, 0, len(words)) for x in (-2 * band, len(template) + 2 * band))
        near = near[known[hi] - known[lo] >= least * len(template)]  # enough of the template's words around
        # an alignment that keeps within ``band`` of its middle keeps within twice that of any of its words
        met += [(first, end, t, n) for n, first, end in places(template, words, known, list(map(tuple, near.tolist())), 2 * band, least)]
    for first, end, t, n in unbeaten(met, [len(x) for x in index.words]):
        a, b = (spans[first][0], spans[end - 1][1]) if spans else (-1, -1)
        yield index.names[t], n / len(index.words[t]), n, a, b


def unbeaten(met: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Of matches (first, end, template, words) those that no overlapping one beats in coverage, with as many words: kindred notices differ in a few."""
    met = sorted(met)
    lost = [False] * len(met)
    for i, (_, end, t, n) in enumerate(met):
        for j in range(i + 1, len(met)):
            first, _, u, m = met[j]
            if first >= end:
                break
            if m >= n and m * sizes[t] > n * sizes[u]:
                lost[i] = True
            if n >= m and n * sizes[u] > m * sizes[t]:
                lost[j] = True
    return [x for x, gone in zip(met, lost, strict=True) if not gone]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = 8, least: float = 0.8, most_words: int | None = None) -> DataFrame:
    """Matches of license templates: doc_id, license, coverage, matched_words, start, end; a row for each match.

    Of overlapping matches of kindred templates the one of the largest coverage is given.

    :param band: words by which a match may run ahead of the template or fall behind it, from its middle. A
        notice with a longer clause put in counts as two parts, of which each must reach ``least`` alone.
    :param least: share of the template's words, in order, that a match needs.
    :param most_words: templates are scanned in lots of at most so many words (or one template), a pass each,
        so that no task holds more; None for one pass.

    Texts are scanned whole, words without case and signs. start and end count characters of the text; -1 if
    lower-casing changes its words. Null and empty texts have no matches, nor has an empty table. Null and
    repeated doc_ids are kept, a row for each match of each row. Other columns are not read.
    """
    lots: list[dict[str, str]] = [{}]
    size = 0
    for name, text in (TEMPLATES if templates is None else templates).items():
        n = len(_word.findall(text.lower()))
        if most_words is not None and lots[-1] and size + n > most_words:
            lots.append({})
            size = 0
        lots[-1][name] = text
        size += n
    parts = [_scan(docs, build(x, least), band, least) for x in lots]
    return reduce(DataFrame.union, parts)


def _scan(docs: DataFrame, index: Index, band: int, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
        for b in batches:
            rows = [(k, *m) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in matches(x, index, band, least)]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "license", "coverage", "matched_words", "start", "end"])

    schema = "doc_id long, license string, coverage double, matched_words int, start long, end long"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").withColumn("text", text_col()).mapInArrow(run, schema)
