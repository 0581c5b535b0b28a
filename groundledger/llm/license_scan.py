"""License scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised alike: lower case, punctuation dropped, words
split at everything else, lines ignored. A template of a bigrams is compared with
windows of b bigrams of a text, wherever they begin. By the size bounds, a window
can only reach the coefficient d if d/(2-d) * a <= b <= (2-d)/d * a, and then it
holds d/(2-d) * a of the template's bigrams or more. Windows begin and end on
bigrams of the template, as all others are worse than these; places where too few
of them lie close enough together are never compared.

Defined cases: null and empty texts have no licence; several licences in a text
are reported each, with the best window (of equals the first, then the shortest),
but for one that shares words with a better window of another;
repeated rows are reported once a row; texts of any length are scanned whole;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import U64, find_words, ngrams, parts

#: Public licence notices, as they stand in source files and documents.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Released under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "Licensed under the GNU General Public License, Version 3."),
    ("GPL", "Released under the GNU General Public License."),
    ("GPL", "Licensed under GPL-3.0."),
    ("GPL", "Released under the GNU GPL version 3."),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

_MEMBER = np.zeros(256, bool)
_MEMBER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


class Templates:
    """Templates as hashed bigrams, and for every bigram the templates that have it."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float) -> None:
        self.least, ratio = least, least / (2 - least)
        words = find_words(pa.array([text for _, text in templates], pa.string()), members=_MEMBER)
        value, whole = ngrams(words, 2)
        self.names = [name for name, _ in templates]
        self.counts = [Counter(value[a:b][whole[a:b]].tolist()) for a, b in zip(words.off[:-1], words.off[1:], strict=True)]
        self.size = np.array([c.total() for c in self.counts])
        #: Bigrams of a template that a window needs, and bigrams that it may have.
        self.need = np.ceil(ratio * self.size - 1e-9).astype(np.int64)
        self.most = np.floor(self.size / ratio + 1e-9).astype(np.int64)
        pairs = sorted((v, k) for k, c in enumerate(self.counts) for v in c)
        self.value = np.array([v for v, _ in pairs], U64)
        self.of = np.array([k for _, k in pairs], np.int64)

    def scan(self, column: pa.Array) -> list[tuple[int, str, float, int, int]]:
        """(row, licence, dice, first word, words) of the best window of every text and licence."""
        words = find_words(column, members=_MEMBER)
        value, whole = ngrams(words, 2)
        at = np.flatnonzero(whole)
        at = at[np.isin(value[at], self.value)]
        first = np.searchsorted(self.value, value[at])
        many = np.searchsorted(self.value, value[at], "right") - first
        place = np.repeat(at, many)
        template = self.of[np.repeat(first, many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)]
        order = np.lexsort((place, template))
        place, template = place[order], template[order]
        row = words.row[place]
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        edge = np.searchsorted(template, np.arange(len(self.size) + 1))
        for t, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            k = int(self.need[t])
            if not k or hi - lo < k:
                continue
            own, rows = place[lo:hi], row[lo:hi]
            close = (own[k - 1 :] - own[: hi - lo - k + 1] < self.most[t]) & (rows[k - 1 :] == rows[: hi - lo - k + 1])
            for i in np.flatnonzero(close).tolist():
                self._from(t, i, k, own, rows, value, best)
        out: list[tuple[int, str, float, int, int]] = []
        kept: dict[int, list[tuple[float, int, int]]] = {}
        for (r, name), (dice, p, n) in sorted(best.items(), key=lambda x: (x[0][0], -x[1][0], x[0][1])):
            # A window that shares words with another licence's better one is that licence, not this.
            if not any(d > dice and q < p + n and p < q + m for d, q, m in kept.get(r, ())):
                kept.setdefault(r, []).append((dice, p, n))
                out.append((r, name, dice, p - int(words.off[r]), n))
        return sorted(out)

    def _from(self, t: int, i: int, k: int, own: np.ndarray, rows: np.ndarray, value: np.ndarray, best: dict) -> None:
        """Tries the windows of template t that begin on its i-th bigram in the texts."""
        size, start, r = int(self.size[t]), int(own[i]), int(rows[i])
        left, common = Counter(self.counts[t]), 0
        key = r, self.names[t]
        for j in range(i, len(own)):
            n = int(own[j]) - start + 1
            if rows[j] != r or n > self.most[t]:
                break
            v = int(value[own[j]])
            if left[v]:
                left[v] -= 1
                common += 1
            score = 2 * common / (size + n)
            if score >= self.least and (key not in best or (-score, start, n + 1) < (-best[key][0], *best[key][1:])):
                best[key] = score, start, n + 1


def license_scan(documents: DataFrame, least: float = 0.75, templates: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, first_word, n_words) for each licence found in documents(doc_id, text); words are normalised ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for part in parts(batches):
            rows = known.scan(part.column("text"))
            if rows:
                row, *cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()).take(pa.array(row))]
                    + [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "license", "dice", "first_word", "n_words"],
                )

    return documents.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, license string, dice double, first_word long, n_words long"
    )
