"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A unit is a line, a run of neighbouring lines that mostly consist of template
bigrams, or the whole text.  Words are runs of ASCII letters, digits and non-ASCII characters, without
case.  The coefficient of a unit with a distinct bigrams and a template with b,
c of them common, is 2c / (a + b).  It reaches t only if a lies within b * t / (2 - t)
and b * (2 - t) / t, so only templates within these size bounds are compared; and
only if c >= b * t / (2 - t) at least, so units with fewer template bigrams are passed over at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

# Parts of licence texts that several of them share, common licence notices, openings and whole texts.
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
MIT_HEAD = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
MIT_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
APACHE_NOTICE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL_THREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL_TWO = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", MIT_HEAD),
    ("MIT", f"{MIT_HEAD} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {MIT_TAIL}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", GPL_THREE),
    ("GPL-3.0", f"{GPL_THREE} {GPL_REST}"),
    ("GPL-2.0", GPL_TWO),
    ("GPL-2.0", f"{GPL_TWO} {GPL_REST}"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", BSD_HEAD),
    ("BSD-3-Clause", BSD_HEAD),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_TWO} {BSD_TAIL}"),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_TWO} {BSD_THIRD} {BSD_TAIL}"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", ISC_HEAD),
    ("ISC", f"{ISC_HEAD} {ISC_TAIL}"),
    ("Zlib", ZLIB),
    ("Apache-2.0", APACHE_NOTICE),
    ("MPL-2.0", MPL_NOTICE),
    ("Unlicense", UNLICENSE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]

_JOIN = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True


def bigrams(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigram hashes, byte where each begins) of bytes; none reaches over an offset of ``breaks``."""
    clean = np.where(_WORD[data], data, np.uint8(32))
    start = _WORD[data].copy()
    start[1:] &= ~_WORD[data][:-1]
    at = np.flatnonzero(start)
    if len(at) < 2:
        return np.zeros(0, np.uint64), at[:0]
    words, _ = tx.word_hashes(clean, np.array([0, len(clean)]))
    ok = np.searchsorted(breaks, at[:-1], side="right") == np.searchsorted(breaks, at[1:], side="right")
    return tx.mix(words[:-1] * _JOIN + words[1:])[ok], at[:-1][ok]


def bigram_set(text: str) -> np.ndarray:
    return np.unique(bigrams(np.frombuffer(text.encode(), np.uint8), np.zeros(0, np.int64))[0])


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = 0.8):
        self.names = [n for n, _ in templates]
        self.sets = [bigram_set(t) for _, t in templates]
        self.threshold = threshold
        self.size = np.array([len(s) for s in self.sets])
        self.known = np.unique(np.concatenate(self.sets))
        #: A unit with fewer bigrams of the templates reaches no template.
        self.least = max(1, math.ceil(self.size.min() * threshold / (2 - threshold) - 1e-9))

    def best(self, unit: np.ndarray) -> tuple[float, str, int]:
        """(coefficient, licence, bigrams in common) of a unit's distinct bigrams; licences whose templates tie are all named."""
        a, t = len(unit), self.threshold
        fits = np.flatnonzero((a * (2 - t) >= self.size * t - 1e-9) & (a * t <= self.size * (2 - t) + 1e-9))
        top, names, common = 0.0, [], 0
        for k in fits:
            c = np.isin(self.sets[k], unit, assume_unique=True).sum()
            dice = 2.0 * c / (a + self.size[k])
            if dice >= max(t, top):
                names = [*names, self.names[k]] if dice == top else [self.names[k]]
                top, common = dice, int(c)
        return top, " OR ".join(dict.fromkeys(names)), common

    def scan(self, text: bytes):
        """(first line, lines, licence, coefficient) of each matching unit of a text.

        Of units that overlap, that with most bigrams in common with its template is reported; of ties, the nearer, then the shorter.
        So a licence of several paragraphs is one unit, whatever its lines say by themselves.
        """
        data = np.frombuffer(text, np.uint8)
        breaks = np.flatnonzero(data == 10)
        h, at = bigrams(data, np.zeros(0, np.int64))
        known = np.isin(h, self.known)
        if known.sum() < self.least:
            return
        line, n_lines = np.searchsorted(breaks, at, side="right"), len(breaks) + 1
        # a bigram that reaches over a line's end counts for runs and the whole text only
        inner = np.ones(len(h), bool)
        inner[:-1] = line[1:] == line[:-1]
        if len(h):
            _, word_at = bigrams(data, breaks)
            inner = np.isin(at, word_at, assume_unique=True)
        start = _WORD[data]
        word_line = np.searchsorted(breaks, np.flatnonzero(start & ~np.concatenate([[False], start[:-1]])), side="right")
        all_of, hit = np.bincount(line[inner], minlength=n_lines), np.bincount(line[inner & known], minlength=n_lines)
        units = [(int(k), int(k) + 1) for k in np.flatnonzero(hit >= self.least)]
        # lines without words neither break a run nor begin or end one
        spoken = np.flatnonzero(np.bincount(word_line, minlength=n_lines))
        mostly = (2 * hit >= np.maximum(all_of, 1))[spoken]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mostly.astype(np.int8), [0]])))
        units += [(int(spoken[a]), int(spoken[b - 1]) + 1) for a, b in zip(edges[::2], edges[1::2]) if b - a > 1]
        if n_lines > 1 and (0, n_lines) not in units:
            units.append((0, n_lines))
        found = []
        for a, b in units:
            unit = (line >= a) & (line < b)
            unit &= inner | (line < b - 1)
            if (known & unit).sum() >= self.least:
                dice, which, common = self.best(np.unique(h[unit]))
                if which:
                    found.append((-common, -dice, b - a, a, which))
        taken: list[tuple[int, int]] = []
        for _, dice, n, a, which in sorted(found):
            if all(a + n <= x or a >= y for x, y in taken):
                taken.append((a, a + n))
                yield a, n, which, -dice


def _scan(scanner: Scanner):
    def run(batches):
        for batch in batches:
            data, offsets, _ = tx.binary_parts(batch.column(1))
            rows: list[tuple] = []
            for i, j in tx.chunks(offsets):
                lo = int(offsets[i])
                # texts without enough template bigrams are found for the whole run at once
                h, at = bigrams(data[lo : offsets[j]], offsets[i : j + 1] - lo)
                doc = np.searchsorted(offsets[i : j + 1] - lo, at[np.isin(h, scanner.known)], side="right") - 1
                for d in np.flatnonzero(np.bincount(doc, minlength=j - i) >= scanner.least) + i:
                    rows += [(d, *m) for m in scanner.scan(data[offsets[d] : offsets[d + 1]].tobytes())]
            at, first, lines, names, dice = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pc.take(batch.column(0), pa.array(at, pa.int64())), pa.array(first, pa.int32()), pa.array(lines, pa.int32()), pa.array(names, pa.string()), pa.array(dice, pa.float64())],
                ["doc_id", "first_line", "n_lines", "license", "dice"],
            )

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_line, n_lines, license, dice): each unit of a text that matches a template.

    Lines count from 0.  The best template is named; licences whose templates are equally near, such as those that share a
    head, are named together (A OR B).  Null and empty
    texts, and texts without a match, give no row.  A unit with fewer than two words has no
    bigram and matches nothing.  Texts are scanned whole, however long; an empty table gives an empty result.  Repeated rows give repeated results; null ids pass through; extra columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_scan(Scanner(templates, threshold)), f"doc_id {kind}, first_line int, n_lines int, license string, dice double")
