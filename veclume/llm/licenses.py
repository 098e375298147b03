"""License scan: winnowed fingerprints of templates find candidates, banded alignment measures them.

A template is a sequence of words (runs of letters and digits, lower case). The
hashes of its runs of ``gram`` words are winnowed: of every ``window`` in a row
the smallest is kept, so that any ``gram + window - 1`` words in a row hold a
kept one. The kept hashes form an inverted index, hash -> (template, place). A
document looks up every run of its words; each hit proposes a diagonal, around
which the template is aligned locally with the document within a band, unless a
span found before accounts for the hit. What is reported is the share of the template's words
matched in place, and the span of the document, in characters.

A changed word breaks ``gram`` runs, and of a template under ``SHORT`` words that
may be all. Such templates are indexed by each of their words: wherever as many
words of a template as it takes stand close enough to be aligned within the
band, each of them is a hit, and the diagonals with most hits come first. In
longer templates the winnowing finds a copy if any ``gram + window - 1`` words in a
row are unchanged; one with a change in every few words can be missed.

Cases: a null, empty, blank or wordless text matches nothing; a very long text is
hashed in parts and matched as a whole; a null doc_id is reported as null;
repeated rows are reported as often as they come; an empty table gives no rows;
other columns, whatever their names, aren't read; ids are whole numbers, and one
that can't be cast to BIGINT ends the job; of spans
that overlap the one that matches most words stays, then the one that covers
more of its template, then the earlier, then the name that sorts first; a
document may hold several templates and one template several times.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veclume.llm.near_dedup import shingles
from veclume.llm.shared import pieces, text_batches, utf8

#: Notices, openings of longer texts, and whole texts of up to 250 words, in general use. The longer texts are in ``whole_texts``.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSL-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unicode-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of data files and any associated documentation (the \"Data Files\")",
    "Unicode-3.0": "Permission is hereby granted, free of charge, to any person obtaining a copy of data files and any associated documentation (the \"Data Files\") or software and any associated documentation (the \"Software\") to deal in the Data Files or Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, and/or sell copies of the Data Files or Software, and to permit persons to whom the Data Files or Software are furnished to do so, provided that either (a) this copyright and permission notice appear with all copies of the Data Files or Software, or (b) this copyright and permission notice appear in associated Documentation. THE DATA FILES AND SOFTWARE ARE PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR HOLDERS INCLUDED IN THIS NOTICE BE LIABLE FOR ANY CLAIM, OR ANY SPECIAL INDIRECT OR CONSEQUENTIAL DAMAGES, OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THE DATA FILES OR SOFTWARE.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
}

#: Templates of fewer words are found by their words, others by runs of words.
SHORT = 20

#: Whole texts too long to stand here, a file each, named by license.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


def whole_texts() -> dict[str, str]:
    """The whole texts of the longer licenses."""
    out = {}
    for file in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, file), encoding="utf-8") as f:
            out[file.removesuffix(".txt")] = f.read()
    return out


#: Bytes of letters and digits stay, lower case; other ASCII divides words. Bytes beyond ASCII count as letters.
_CLASS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def _words(text: str) -> list[str]:
    return text.encode().translate(_CLASS).decode("utf-8", "replace").split()


def _spans(text: str) -> list[tuple[int, int]]:
    """Where the words of ``text`` are, in characters."""
    return [m.span() for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text)]


def _hash(text: str, width: int) -> np.ndarray:
    raw = np.frombuffer(text.encode().translate(_CLASS), np.uint8)
    return shingles(raw, np.array([0, len(raw)]), width)[0]


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the hashes kept: the smallest of every ``window`` in a row, the last of equals."""
    if len(hashes) <= window:
        return [len(hashes) - 1 - int(hashes[::-1].argmin())] if len(hashes) else []
    last = window - 1 - np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1].argmin(1)
    return np.unique(np.arange(len(last)) + last).tolist()


def _bits(known: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(known >> np.uint64(44)).astype(np.int64)] = True
    return bits


def _found(h: np.ndarray, known: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``h`` is among ``known``, and which it is there."""
    at = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
    if not len(known):
        return at[:0], at[:0]
    k = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
    same = known[k] == h[at]
    return at[same], k[same]


class Index:
    """Inverted index of the templates' fingerprints, with a table of bits before it that turns most lookups away.

    ``by_word`` is the index of the short templates' words.
    """

    def __init__(self, templates: dict[str, str], gram: int, window: int):
        self.names = sorted(templates)
        self.words = [_words(templates[n]) for n in self.names]
        self.gram = gram
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.by_word: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, name in enumerate(self.names):
            if len(self.words[t]) < gram:
                raise ValueError(f"the template {name} has fewer than {gram} words")
            if len(self.words[t]) < SHORT:
                for p, x in enumerate(_hash(templates[name], 1)):
                    self.by_word[int(x)].append((t, p))
                continue
            h = _hash(templates[name], gram)
            for p in winnow(h, window):
                self.at[int(h[p])].append((t, p))
        self.short = np.array(sorted(self.by_word), np.uint64)
        self.maybe_short = _bits(self.short)
        #: for each short template, which of the words in ``short`` it has
        self.has = {t: np.array([any(u == t for u, _ in self.by_word[int(x)]) for x in self.short], bool) for t in range(len(self.names)) if len(self.words[t]) < SHORT}
        self.known = np.array(sorted(self.at), np.uint64)
        self.maybe = _bits(self.known)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Where the runs of words are fingerprints."""
        return _found(h, self.known, self.maybe)[0]

    def word_hits(self, h: np.ndarray, of: np.ndarray, band: int, least: float) -> dict[int, list[tuple[int, int]]]:
        """Document -> (place in ``h``, short template), where as many words of the template as it takes are close together."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        at, which = _found(h, self.short, self.maybe_short)
        for t, has in self.has.items():
            mine, n = at[has[which]], len(self.words[t])
            need = math.ceil(least * n - 1e-9)
            if len(mine) < need:
                continue
            first, last = mine[: len(mine) - need + 1], mine[need - 1 :]
            close = (last - first < n + 2 * band) & (of[first] == of[last])
            dense = np.zeros(len(mine) + 1, np.int64)
            np.add.at(dense, np.flatnonzero(close), 1)
            np.add.at(dense, np.flatnonzero(close) + need, -1)
            for x in mine[np.cumsum(dense[:-1]) > 0].tolist():
                out[int(of[x])].append((x, t))
        return out


def align(doc: list[str], template: list[str], shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment whose diagonals are within ``band`` of ``shift``.

    Word j of the template lies on diagonal d at word j + d of the document. A
    match counts 2, anything else -1; the span runs over the document's words.
    """
    lo, width, n = shift - band, 2 * band + 1, len(doc)
    score, hits, start = [0] * width, [0] * width, [0] * width
    best = (0, 0, 0, 0)
    for j, w in enumerate(template):
        now, got, began = [0] * width, [0] * width, [0] * width
        for d in range(width):
            i = j + lo + d
            if i < 0 or i >= n:
                continue
            same = doc[i] == w
            s, h, b = score[d] + (2 if same else -1), hits[d] + same, start[d] if score[d] > 0 else i
            if d + 1 < width and (score[d + 1] - 1, hits[d + 1]) > (s, h):  # a word of the template is missing
                s, h, b = score[d + 1] - 1, hits[d + 1], start[d + 1]
            if d and (now[d - 1] - 1, got[d - 1]) > (s, h):  # a word of the document is extra
                s, h, b = now[d - 1] - 1, got[d - 1], began[d - 1]
            if s > 0:
                now[d], got[d], began[d] = s, h, b
                if same and (s, h, -b) > (best[0], best[1], -best[2]):
                    best = (s, h, b, i + 1)
        score, hits, start = now, got, began
    return best[1], best[2], best[3]


def match(text: str, index: Index, hits: list[tuple[int, int]], words: list[tuple[int, int, int]], band: int, least: float) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, words matched, start, end) for the hits (word of the document, hash) of one text, and its words (place, hash, template) of short templates."""
    doc, where = _words(text), _spans(text)
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, h in hits:
        for t, p in index.at[h]:
            places[t].append((i - p, i))
    for i, h, t in words:
        places[t] += [(i - p, i) for u, p in index.by_word[h] if u == t]
    found = []
    for t, some in places.items():
        template, spans, failed, left = index.words[t], [], None, list(doc)
        need, short = Counter(template), len(template) < SHORT
        support = Counter(d for d, _ in some)
        for d, i in sorted(some, key=lambda x: (-support[x[0]], x)) if short else sorted(some):
            # a span that was found accounts for its hits, and a failure for the diagonals in its band
            if any(a <= i < b for a, b in spans) or (failed is not None and d - failed <= band):
                continue
            lo, hi = max(0, d - band), min(len(doc), d + band + len(template))
            # the words in common bound the words matched, which spares the alignment of long texts for a chance hit
            n, a, b = align(left[lo:hi], template, d - lo, band) if (need & Counter(left[lo:hi])).total() / len(template) >= least else (0, 0, 0)
            if n / len(template) < least:
                failed = None if short else d  # a stray word's failure says nothing of the diagonals beside it
                continue
            a, b = lo + a, lo + b
            spans.append((a, b))
            left[a:b] = [""] * (b - a)
            found.append((-n, -n / len(template), a, b, index.names[t]))
    out, starts, ends = [], [], []
    for n, share, a, b, name in sorted(set(found)):
        at = bisect_right(starts, a)
        if (at and ends[at - 1] > a) or (at < len(starts) and starts[at] < b):
            continue
        starts.insert(at, a)
        ends.insert(at, b)
        out.append((name, round(-share, 6), -n, where[a][0], where[b - 1][1]))
    return sorted(out, key=lambda r: (r[3], r[0]))


TYPE = "doc_id bigint, license string, coverage double, matched int, start int, `end` int"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, gram: int = 3, window: int = 3, band: int = 8, least: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, matched, start, end): each place where ``least`` of a template's words are found.

    ``templates`` left out are ``TEMPLATES`` and ``whole_texts``.
    """
    text_batches(docs.sparkSession)
    known = {**TEMPLATES, **whole_texts()} if templates is None else dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(known, gram, window)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            rows = []
            for lo, hi in pieces(offsets):
                at = offsets[lo : hi + 1]
                plain = np.frombuffer(raw[at[0] : at[-1]].tobytes().translate(_CLASS), np.uint8)
                h, per = shingles(plain, at - at[0], gram)
                first = np.concatenate([[0], np.cumsum(per)])
                spots = index.hits(h)
                of = np.searchsorted(first, spots, side="right") - 1
                w, per_word = shingles(plain, at - at[0], 1)
                first_word = np.concatenate([[0], np.cumsum(per_word)])
                words = index.word_hits(w, np.repeat(np.arange(hi - lo), per_word), band, least)
                for d in sorted({*of.tolist(), *words}):
                    mine = spots[of == d]
                    row = lo + d
                    short = [(int(x - first_word[d]), int(w[x]), t) for x, t in words.get(d, [])]
                    found = match(batch.column(1)[row].as_py(), index, [(int(x - first[d]), int(h[x])) for x in mine], short, band, least)
                    rows += [(batch.column(0)[row].as_py(), *f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "license", "coverage", "matched", "start", "end"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("text IS NOT NULL").mapInArrow(run, TYPE)
