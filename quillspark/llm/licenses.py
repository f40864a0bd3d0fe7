"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Words are lower-cased and stripped to letters and digits. Every run of ``GRAM``
words of a template has a hash; of each ``WINNOW`` neighbouring ones the least
is a fingerprint (Schleimer, Wilkerson and Aiken's winnowing; a template that
short keeps all). An inverted index leads from fingerprints to templates and
places. All runs of a document are looked up in it, so a shared passage of
GRAM + WINNOW - 1 words can't be missed. Hits of one template on about one
diagonal are a candidate. A banded alignment of the template with the document
around that diagonal counts matched words, with up to ``BAND`` words (a quarter
of a short template's) inserted or left out on the way; it is reported if its coverage of the template is
``COVERAGE`` or more, with the span from its first to its last matched word. A
template of ``SHORT`` words at most must also match in its runs of words that
aren't ``COMMON``, each without a gap: those name the license and its version.

The index is a fixed table of the templates' fingerprints; documents are read
once, without a shuffle.

Defined results: null and empty texts have no matches; of overlapping matches
the one of the highest coverage is reported, then of the longest template;
repeated rows are reported each;
other columns are ignored; spans are in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Recent, documents, slices, table

GRAM, WINNOW, BAND, COVERAGE = 3, 4, 8, 0.8
CACHE, SHORT = 400_000, 12
COMMON = frozenset("a is license licensed released the this under work".split())
# The wording of public licenses and of common notices about them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "gpl-2.0-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "lgpl-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "mit-0-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "gfdl-1.3-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "cc-by-sa-4.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",
}
#: Words that bands side by side may cover at once.
CELLS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\S+")


def _hash(word: str) -> int:
    """Hash of a word's letters and digits, 0 if it has none."""
    plain = "".join(c for c in word.lower() if c.isalnum())
    return xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) | 1 if plain else 0


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    n = max(0, len(words) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = (h ^ words[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the least hash, the rightmost of equals, in each window of WINNOW; all places if there is no whole window."""
    if len(h) < WINNOW:
        return np.arange(len(h))
    windows = np.lib.stride_tricks.sliding_window_view(h, WINNOW)
    return np.unique(np.arange(len(windows)) + WINNOW - 1 - np.argmin(windows[:, ::-1], axis=1))


class Scanner:
    """The inverted index of some templates, and what a worker needs to scan texts with it."""

    def __init__(self, templates: dict[str, str]):
        self.names = [*templates]
        self.words = [np.array([h for w in text.split() if (h := _hash(w))], np.uint64) for text in templates.values()]
        self.bands = [max(1, min(BAND, len(w) // 4)) for w in self.words]
        self.runs = [self._runs(text) for text in templates.values()]
        entries = []
        for k, words in enumerate(self.words):
            h = grams(words)
            entries += [(int(h[p]), k, int(p)) for p in winnow(h)]
        entries.sort()
        self.keys = np.array([e[0] for e in entries], np.uint64)
        self.owner, self.place = [e[1] for e in entries], [e[2] for e in entries]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.hashes = Recent(CACHE)

    @staticmethod
    def _runs(text: str) -> list[list[int]]:
        """A short template's runs of words that name it; none of a longer one's."""
        words = [w for w in text.split() if _hash(w)]
        if len(words) > SHORT:
            return []
        named = [h if (h := _hash(w)) not in {*map(_hash, COMMON)} else 0 for w in words]
        return [[*run] for own, run in groupby(named, bool) if own]

    def _named(self, k: int, words: list[int]) -> bool:
        """Whether a template's runs stand among the matched words, in order."""
        at = 0
        for run in self.runs[k]:
            at = next((p + len(run) for p in range(at, len(words) - len(run) + 1) if words[p : p + len(run)] == run), -1)
            if at < 0:
                return False
        return True

    def scan(self, texts: list[str]) -> list[list[tuple[str, float, int, int]]]:
        """For each text its matches: template, coverage, begin and end in code points."""
        split = [t.split() for t in texts]
        new = self.hashes.settle(set().union(*split) if split else set())
        self.hashes.update((w, _hash(w)) for w in new)
        look = self.hashes.__getitem__
        return [self._scan(t, np.fromiter(map(look, ws), np.uint64, len(ws))) for t, ws in zip(texts, split, strict=True)]

    def _scan(self, text: str, raw: np.ndarray) -> list[tuple[str, float, int, int]]:
        kept = np.flatnonzero(raw)
        words = raw[kept]
        h = grams(words)
        likely = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        if not len(likely):
            return []
        low, high = np.searchsorted(self.keys, h[likely]), np.searchsorted(self.keys, h[likely], "right")
        hits = sorted((self.owner[e], p - self.place[e]) for p, a, b in zip(likely.tolist(), low.tolist(), high.tolist(), strict=True) for e in range(a, b))
        bands: list[tuple[int, int, int]] = []
        for k, diagonal in hits:
            if bands and bands[-1][0] == k and diagonal - bands[-1][2] <= self.bands[k]:
                bands[-1] = (k, bands[-1][1], diagonal)
            else:
                bands.append((k, diagonal, diagonal))
        found = []
        alike: dict[tuple[int, int], list[int]] = {}  # bands of one template and width are aligned side by side
        for k, first, last in bands:
            alike.setdefault((k, last - first), []).append(first - self.bands[k])
        told = []
        for (k, wide), lows in alike.items():
            told += [(k, *x) for x in zip(*(v.tolist() for v in aligned(self.words[k], words, np.array(lows), wide + 2 * self.bands[k] + 1)), strict=True)]
        for k, matched, begin, end in told:
            if matched >= COVERAGE * len(self.words[k]) and self._named(k, words[begin : end + 1].tolist()):
                found.append((k, matched / len(self.words[k]), begin, end))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        best: list[tuple[int, float, int, int]] = []
        for k, coverage, begin, end in sorted(found, key=lambda x: (-x[1], -len(self.words[x[0]]), x[2], x[0])):
            if all(end < b or e < begin for _, _, b, e in best):
                best.append((k, coverage, begin, end))
        return sorted((self.names[k], c, spans[kept[b]][0], spans[kept[e]][1]) for k, c, b, e in best)


def align(template: np.ndarray, words: np.ndarray, first: int, last: int, band: int = BAND) -> tuple[int, int, int]:
    """The most words that match in order within the band; and the places of the first and the last."""
    matched, begin, end = aligned(template, words, np.array([first - band]), last - first + 2 * band + 1)
    return int(matched[0]), int(begin[0]), int(end[0])


def aligned(template: np.ndarray, words: np.ndarray, lows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for several bands of one width, side by side.

    Cell j of row i of a band stands for word i + low + j; scores are the longest
    common subsequence within the band, ties to the latest begin, then to the
    least end. A cell is one number (matched, begin, end), so a row is the
    running maximum of what comes from above and of what matches.
    """
    reach = width + len(template)
    size = reach + 2  # begin and end count from low, from 1 on; 0 is none
    one = size * size
    parts = []
    for at in range(0, len(lows), max(1, CELLS // reach)):
        low = lows[at : at + max(1, CELLS // reach)]
        places = low[:, None] + np.arange(reach)
        near = np.where((places >= 0) & (places < len(words)), words[np.clip(places, 0, max(0, len(words) - 1))], np.uint64(0)) if len(words) else np.zeros(places.shape, np.uint64)
        row = np.zeros((len(low), width + 1), np.int64)
        top = np.zeros(len(low), np.int64)
        for i, word in enumerate(template):
            cell = row[:, 1:].copy()
            r, c = np.nonzero(near[:, i : i + width] == word)
            before, place = row[r, c], i + c + 1
            begin = np.where(before >= one, before // size % size, place)
            cell[r, c] = np.maximum(cell[r, c], (before // one + 1) * one + begin * size + place)
            np.maximum.accumulate(cell, axis=1, out=row[:, :width])
            # The end counts down here, so that the least is the greatest; later rows don't take an equal one's place.
            end = row[:, :width] % size
            top = np.maximum(top, (row[:, :width] - end + np.where(end > 0, size - end, 0)).max(axis=1))
        found = top >= one
        parts.append((top // one, np.where(found, top // size % size - 1 + low, 0), np.where(found, size - top % size - 1 + low, -1)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row a match: doc_id, license, coverage, begin, end and the matched text."""
    wanted = TEMPLATES if templates is None else templates

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            rows = [(d, *m, t[m[2] : m[3]]) for d, t, ms in zip(batch.column("doc_id").to_pylist(), texts, scanner.scan(texts), strict=True) for m in ms]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "license", "coverage", "begin", "end", "matched"])

    return documents(docs).mapInArrow(work, "doc_id long, license string, coverage double, begin long, end long, matched string")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice found in the documents."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "license", F.round("coverage", 6).alias("coverage"), "begin", "end", "matched")
