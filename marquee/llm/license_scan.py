"""License scan: winnowed fingerprints find candidates, banded alignment reports the match.

Fingerprints of the templates form an inverted index. A text's fingerprints that meet it give
a template and a place in it; around such an anchor a banded local alignment of words gives
the matched spans and how much of the template they cover. As a match may keep no fingerprint,
each template is also indexed by so many of its words that a match must keep one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passes import in_passes
from .text import hash_spans, mix, pieces, spans_of, utf8

#: Words in a gram, grams in a window, words off the diagonal unless told, and the least coverage reported.
GRAM, WINNOW, BAND, COVERAGE = 3, 4, 8, 0.75
#: Words of the templates in one index, which every task holds.
BLOCK_WORDS = 1_000_000
MATCH, MISS, GAP = 2, -1, -1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

# Short notices as licenses state them, and whole licenses (public texts).
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_LIST = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": f"{_MIT}.",
    "MIT-text": f"{_MIT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "BSD-notice": f"{_BSD}.",
    "BSD-2-text": f"{_BSD}: {_BSD_LIST} {_BSD_END}",
    "BSD-3-text": f"{_BSD}: {_BSD_LIST} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "ISC-text": f"{_ISC} {_ISC_END}",
    "Zlib-text": _ZLIB,
    "Unlicense-notice": _UNLICENSE,
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[data]
    starts, ends, before = spans_of(_WORD[low], offsets)
    return hash_spans(low, starts, ends), starts, ends, before


def grams(words: np.ndarray, gram: int) -> np.ndarray:
    n = len(words) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(gram):
        out = mix(out * np.uint64(31) + words[k : k + n])
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the last least hash of each window of hashes."""
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))


class Templates:
    """The inverted index: sorted fingerprints with their size, template and place.

    Templates are winnowed and texts give all their grams, so that any stretch of
    gram + window - 1 words that a text shares with a template meets the index. Templates of
    few grams are indexed by all of them. A match at the least coverage may miss some words of
    its template; one word more than those, the rarest by a guess, are in the index too, so
    that every match meets it.
    """

    def __init__(self, templates: list[tuple[str, str]], gram: int = GRAM, window: int = WINNOW, coverage: float = COVERAGE):
        self.gram, self.window = gram, window
        self.names = [name for name, _ in templates]
        hashes, starts, ends, before = words_of(*utf8(pa.array([t for _, t in templates], pa.large_string())))
        self.words = [hashes[a:b] for a, b in zip(before[:-1], before[1:])]
        self.smaller = [min(gram, len(w)) for w in self.words]
        self.least = np.array([next((k for k in range(1, len(w) + 1) if k >= coverage * len(w)), 1) for w in self.words], np.int64)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.vocabulary, ids, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.counts = [np.unique(ids[a:b], return_counts=True) for a, b in zip(before[:-1], before[1:])]
        rare = np.lexsort([-(ends - starts), counts[ids]])  # by use in templates, then the longest
        rank = np.empty(len(hashes), np.int64)
        rank[rare] = np.arange(len(hashes))
        keys, which, place, size = [], [], [], []
        for t, words in enumerate(self.words):
            if not len(words):
                continue
            own = grams(words, self.smaller[t])
            at = winnow(own, window) if len(own) > window else np.arange(len(own))
            alone = np.argsort(rank[before[t] : before[t + 1]], kind="stable")[: len(words) - self.least[t] + 1]
            if self.smaller[t] == 1:
                at, own, alone = np.arange(1), own, alone[:0]
            keys += [own[at], grams(words, 1)[alone]]
            place += [at, alone]
            size += [np.full(len(at), self.smaller[t]), np.ones(len(alone), np.int64)]
            which.append(np.full(len(at) + len(alone), t))
        keys, which, place, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, which, place, size))
        order = np.argsort(keys, kind="stable")
        self.keys, self.which, self.place, self.size = keys[order].astype(np.uint64), which[order], place[order], size[order]
        self.sizes = np.unique(self.size)[::-1].tolist()

    def candidates(self, hashes: np.ndarray, before: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Distinct (text, template, place in the text, diagonal) rows of a batch, those of larger grams first.

        `known` are the words' places in the vocabulary, or -1. Where a match can lie, too few
        known words rule it out.
        """
        found = [np.zeros((0, 4), np.int64)]
        seen = np.concatenate([[0], np.cumsum(known >= 0)])
        for size in self.sizes:
            own = grams(hashes, size)
            text = np.searchsorted(before, np.arange(len(own)), "right") - 1
            inside = np.arange(len(own)) + size <= before[text + 1]
            at = np.flatnonzero(inside & (known[: len(own)] >= 0))
            low, high = np.searchsorted(self.keys, own[at], "left"), np.searchsorted(self.keys, own[at], "right")
            n = high - low
            hit = np.repeat(at, n)
            rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            keep = self.size[rows] == size
            hit, rows = hit[keep], rows[keep]
            t, first, last = self.which[rows], before[text[hit]], before[text[hit] + 1]
            low, high = self.reach(hit - self.place[rows], t)
            keep = seen[np.clip(high, first, last)] - seen[np.clip(low, first, last)] >= self.least[t]
            hit, rows, t, first = hit[keep], rows[keep], t[keep], first[keep]
            found.append(np.unique(np.stack([text[hit], t, hit - first, hit - first - self.place[rows]], 1), axis=0))
        return np.concatenate(found)

    def reach(self, diagonal, t):
        """The words among which a match about a diagonal lies: its score bounds what it inserts by twice the template's words."""
        return diagonal - 2 * self.lengths[t], diagonal + 3 * self.lengths[t]

    def possible(self, known: np.ndarray, t: int) -> bool:
        """Whether these words of a text have enough of a template's in common, in any order."""
        if len(known) < self.least[t]:
            return False
        ids, limits = self.counts[t]
        have, n = np.unique(known[known >= 0], return_counts=True)
        at = np.minimum(np.searchsorted(ids, have), len(ids) - 1)
        return int(np.where(ids[at] == have, np.minimum(n, limits[at]), 0).sum()) >= self.least[t]

    def match(self, text: np.ndarray, known: np.ndarray, t: int, place: int, diagonal: int) -> tuple[int, int, int]:
        """Matches, from and to in the text, of the best alignment that holds a place; none if it has too few matches."""
        low, high = (min(max(int(x), 0), len(text)) for x in self.reach(diagonal, t))
        template = self.words[t]
        while self.possible(known[low:high], t):
            hits, a, b, score = align(text[low:high], template, diagonal - low, 5 * len(template))
            if not score:
                break
            if low + a <= place < low + b:
                return (hits, low + a, low + b) if hits >= self.least[t] else (0, 0, 0)
            low, high = (low + b, high) if low + b <= place else (low, low + a)
        return 0, 0, 0


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int, int]:
    """Best local alignment of words within a band about a diagonal: matches, from, to in the text, and the score.

    A row of the table at a time. Of equal scores a pair of words goes first, then a left-out
    word of the template, then one of the text.
    """
    low, high = max(0, diagonal - band), min(len(text), diagonal + len(template) + band)
    part = text[low:high]
    n = len(part)
    if n <= 0:
        return 0, 0, 0, 0
    score, hits, begin = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        a, b = max(1, diagonal + i - band - low + 1), min(n, diagonal + i + band - low + 1)
        new, new_hits, new_begin = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), np.arange(n + 1)
        if a <= b:
            here, left = slice(a, b + 1), slice(a - 1, b)
            same = part[left] == word
            pair, skip = score[left] + np.where(same, MATCH, MISS), score[here] + GAP
            paired = pair >= skip
            top = np.maximum(pair, skip)
            own = top >= 0
            places = np.arange(a, b + 1)
            own_hits = np.where(own, np.where(paired, hits[left] + same, hits[here]), 0)
            own_begin = np.where(own, np.where(paired, begin[left], begin[here]), places)
            # a cell's value is the best of those before it, less a gap for each word between
            value = 2 * (np.maximum(top, 0) - GAP * places) + own
            source = np.maximum.accumulate(np.where(value == np.maximum.accumulate(value), places - a, 0))
            new[here] = np.maximum(top, 0)[source] + GAP * (places - places[source])
            new_hits[here], new_begin[here] = own_hits[source], own_begin[source]
            j = int(new.argmax())
            if new[j] > best[3]:
                best = (int(new_hits[j]), int(new_begin[j]) + low, j + low, int(new[j]))
        score, hits, begin = new, new_hits, new_begin
    return best


_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("words", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, matches), one for each row of `docs`: license, coverage, matched words, and the span in the text's bytes.

    coverage is the share of the template's words that are matched in order. Matches of one
    template that overlap are one, the best; they are in order of their place and name. Null
    and empty texts have none. Other columns are ignored; repeated rows and null ids stay;
    with one block nothing is shuffled. The templates are a parameter; each block of block_words of their words
    is an index of its own, in a pass of its own over the texts.
    """
    blocks = _blocks(sorted((TEMPLATES if templates is None else templates).items()), block_words)
    out = "matches array<struct<license: string, coverage: double, words: long, from: long, to: long>>"
    by_place = lambda x, y: F.when(x["from"] < y["from"], -1).when(x["from"] > y["from"], 1).when(x["license"] < y["license"], -1).when(x["license"] > y["license"], 1).otherwise(0)
    merged = [F.array_sort(F.flatten(F.collect_list("matches")), by_place).alias("matches")]
    return in_passes(docs, (Templates(block, coverage=coverage) for block in blocks), _scan, out, "size(matches) > 0", merged)


def _blocks(templates: list[tuple[str, str]], words: int) -> Iterator[list[tuple[str, str]]]:
    """The templates in blocks of at most so many words, or of one longer template."""
    held, size = [], 0
    for name, text in templates:
        n = len(text.split())
        if held and size + n > words:
            yield held
            held, size = [], 0
        held.append((name, text))
        size += n
    yield held


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Templates = shared.value
        for batch in pieces(batches):
            hashes, starts, ends, before = words_of(*(x := utf8(batch.column("text"))))
            at = np.minimum(np.searchsorted(index.vocabulary, hashes), max(len(index.vocabulary) - 1, 0))
            known = np.where(index.vocabulary[at] == hashes, at, -1) if len(index.vocabulary) else np.full(len(hashes), -1)
            found: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            done: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for d, t, place, diagonal in index.candidates(hashes, before, known).tolist():
                spans = done.setdefault((d, t), [])
                if any(a <= place < b for a, b in spans):
                    continue  # what holds this place overlaps a match
                part = slice(before[d], before[d + 1])
                hits, a, b = index.match(hashes[part], known[part], t, place, diagonal)
                if hits:
                    spans.append((a, b))
                    found[d].append((index.names[t], hits / len(index.words[t]), hits, a, b))
            out = []
            for d, items in enumerate(found):
                kept: list[tuple] = []
                for m in sorted(items, key=lambda m: (m[0], -m[1], m[4] - m[3], m[3])):
                    if not any(k[0] == m[0] and k[3] < m[4] and m[3] < k[4] for k in kept):
                        kept.append(m)
                base, origin = before[d], x[1][d]
                out.append([{"license": n, "coverage": c, "words": h, "from": int(starts[base + a] - origin), "to": int(ends[base + b - 1] - origin)} for n, c, h, a, b in kept])
            out = [sorted(x, key=lambda m: (m["from"], m["license"])) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _MATCHES)], ["doc_id", "matches"])

    return run
