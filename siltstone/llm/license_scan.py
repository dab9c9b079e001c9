"""License texts in documents, by patience alignment with templates.

A document is searched in windows of two and of three times a template's words,
one template length apart, so any copy of up to twice the template's words lies
whole in some window. A window is aligned if it
shares enough words to reach the threshold at all. The alignment anchors on
words that are unique in both sides, takes the longest increasing subsequence
of the anchors and aligns the gaps between them in the same way.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columns import narrow
from .kernels import slices, word_hashes
from .scratch import small_batches

#: Share of a template's words that must be aligned.
THRESHOLD = 0.8

TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def align(a: list, b: list, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> list[tuple[int, int]]:
    """Pairs of equal positions of ``a[alo:ahi]`` and ``b[blo:bhi]``, increasing in both, by patience.

    Equal words at both ends of a gap are aligned first, so a gap without a
    unique word isn't lost if the two sides are alike.
    """
    found: list[tuple[int, int]] = []
    todo = [(alo, len(a) if ahi is None else ahi, blo, len(b) if bhi is None else bhi)]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        place: dict = {}
        for j in range(blo, bhi):
            place[b[j]] = -1 if b[j] in place else j
        seen: dict = {}
        for i in range(alo, ahi):
            seen[a[i]] = -1 if a[i] in seen else i
        pairs = [(i, place[w]) for w, i in seen.items() if i >= 0 and place.get(w, -1) >= 0]
        if not pairs:
            continue
        pairs.sort()
        tails: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(pairs):
            k = bisect_left(tails, j)
            back.append(piles[k - 1] if k else -1)
            if k == len(tails):
                tails.append(j)
                piles.append(n)
            else:
                tails[k], piles[k] = j, n
        chain, n = [], piles[-1]
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        chain.reverse()
        found += chain
        for (i, j), (k, m) in zip([(alo - 1, blo - 1), *chain], [*chain, (ahi, bhi)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(found)


class Matcher:
    """The templates as word numbers, ready to be searched for."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.names = sorted(n for n, t in templates.items() if t)
        words, offsets = word_hashes(pa.array([templates[n] for n in self.names], pa.string()))
        self.vocabulary = np.unique(words)
        number = np.searchsorted(self.vocabulary, words)
        self.templates = [number[offsets[k] : offsets[k + 1]] for k in range(len(self.names))]
        self.threshold = threshold
        # A template with no words matches nothing.
        self.kinds = [np.unique(t, return_counts=True) for t in self.templates]

    def find(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, float, int, int]]:
        """(row, name, coverage, first word, last word) of the best copy of each template that a row holds."""
        size = len(self.vocabulary)
        if not size or not len(words):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, words), size - 1)
        hit = np.flatnonzero(self.vocabulary[at] == words)
        number = at[hit]
        row = np.searchsorted(offsets, hit, "right") - 1
        rows = len(offsets) - 1
        bounds = np.searchsorted(hit, offsets)
        table = np.bincount(row * size + number, minlength=rows * size).reshape(rows, size)
        for k, (kind, need) in enumerate(self.kinds):
            m = len(self.templates[k])
            if not m:
                continue
            enough = self.threshold * m
            for i in np.flatnonzero(np.minimum(table[:, kind], need).sum(axis=1) >= enough):
                best = self._search(k, hit[bounds[i] : bounds[i + 1]] - offsets[i], number[bounds[i] : bounds[i + 1]], enough)
                if best:
                    yield int(i), self.names[k], best[0] / m, best[1], best[2]

    def _search(self, k: int, place: np.ndarray, number: np.ndarray, enough: float) -> tuple[int, int, int] | None:
        template, (kind, need) = self.templates[k], self.kinds[k]
        m, size = len(template), len(self.vocabulary)
        own = np.isin(number, kind)
        place, number = place[own], number[own]
        window = place // m
        # Words shared by each window: the counts of its own block and of the next one or two. The narrow windows
        # have more words that are unique, the wide ones hold copies whole that have foreign words inside.
        slot = np.unique(np.maximum(np.concatenate([window, window - 1, window - 2]), 0))
        count = np.zeros((len(slot), size), np.int32)
        found = []
        wanted = template.tolist()
        for blocks in (1, 2, 3):
            later = window >= blocks - 1
            np.add.at(count, (np.searchsorted(slot, window[later] - (blocks - 1)), number[later]), 1)
            if blocks == 1:
                continue
            for s in slot[np.minimum(count[:, kind], need).sum(axis=1) >= enough]:
                lo, hi = np.searchsorted(place, [s * m, (s + blocks) * m])
                pairs = align(number[lo:hi].tolist(), wanted)
                if len(pairs) >= enough:
                    found.append((len(pairs), int(place[lo + pairs[0][0]]), int(place[lo + pairs[-1][0]])))
        # The one that ends first of those with most words, and the shortest of these.
        return min(found, key=lambda f: (-f[0], f[2], -f[1]), default=None)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, license, coverage, first_word, last_word)`` for each row of ``docs`` and template in it.

    ``coverage`` is the aligned share of the template's words, for the best
    copy; of equal ones the copy that ends first. A copy may have up to as many foreign words
    inside as it has words. Null, empty and wordless texts hold nothing; a null
    doc_id keeps its row's matches; repeated rows match again; no documents: no
    rows. Other columns aren't read, whatever their names. Texts of any length
    are searched whole. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    matcher = Matcher(TEMPLATES if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = list(matcher.find(*word_hashes(batch.column("text"))))
                rows = pa.array([f[0] for f in found], pa.int64())
                columns = [pa.array([f[i] for f in found], kind) for i, kind in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), *columns], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long")
