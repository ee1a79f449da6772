"""Operator 6: licence scans by Dice coefficient over word bigrams.

A text is lower-cased and reduced to words.  Each licence template slides over
it: every window of as many consecutive words as the template has (the whole
text, if it is shorter) is compared with it by Dice's coefficient 2|A&B| /
(|A|+|B|) of the two sets of word bigrams, wherever lines break.  A coefficient
of t needs sizes within t/(2-t) of each other and t/2 of both sizes in common.
So a template is a candidate only where a stretch of the text has enough of its
distinct bigrams, and a window only if enough of its bigrams are the template's;
what these bounds leave is compared exactly.

Rows are handled where they are read, in Arrow batches: no shuffle.  A text is
taken in pieces of about ``PIECE`` characters that overlap by the longest
template, so a text of any length takes the memory of a piece.

Edge cases: null and empty texts, and those of fewer than two words, have no
matches (count 0, null licence); of a template's windows the highest
coefficient counts, then the first; of templates the highest, then the first in
the text, then the licence's name; repeated rows are scanned alike; the columns
asked for by ``keep`` come through, whatever others there are; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# Public licence notices and texts, as published.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "mit": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "isc": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "cc0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "bsd-2-clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
    "bsd-3-clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ],
}

THRESHOLD = 0.8
#: Characters of a text that are handled at once.
PIECE = 1 << 20
_LOWER = {i: i + 32 for i in range(65, 91)}
_BREAK = re.compile("[^a-z0-9]+")


def words_of(text: str) -> list[str]:
    return [w for w in _BREAK.split(text.translate(_LOWER)) if w]


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams that can reach the threshold against n."""
    low = threshold / (2 - threshold)
    return next(k for k in range(n + 1) if k >= n * low - 1e-9), int(n / low + 1e-9)


def template_table(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    """(licence, number of words, distinct bigrams) of each template text; the shortest first."""
    rows = [(name, words_of(t)) for name, texts in templates.items() for t in texts]
    return sorted(((name, len(w), sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})) for name, w in rows if len(w) > 1), key=lambda x: (x[1], x[0], x[2]))


class Scanner:
    """Finds each template's best window in a text."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold, self.rows = threshold, template_table(templates)
        self.sets = [frozenset(tuple(g.split(" ")) for g in grams) for _, _, grams in self.rows]
        # A window in reach has at least as many bigrams as the lower bound, and half the threshold of both sizes in common.
        self.need = np.array([int(np.ceil(threshold * (size_bounds(len(g), threshold)[0] + len(g)) / 2 - 1e-9)) for g in self.sets])
        self.longest = max(n for _, n, _ in self.rows)

    @cached_property
    def tables(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Ids of the templates' words, of their bigrams by a pair of word ids, and which template has which bigram."""
        vocab = {w: k + 1 for k, w in enumerate(sorted({w for g in self.sets for pair in g for w in pair}))}
        size = len(vocab) + 1
        grams = sorted(set().union(*self.sets))
        of_pair = np.zeros(size * size, np.int32)
        has = np.zeros((len(self.rows), len(grams) + 1), bool)
        for k, (a, b) in enumerate(grams, 1):
            of_pair[vocab[a] * size + vocab[b]] = k
            has[:, k] = [(a, b) in g for g in self.sets]
        return vocab, of_pair, has

    def scan(self, text: str | None) -> list[tuple[float, int, str]]:
        """(coefficient, first word, licence) of each template's best window that reaches the threshold."""
        best: dict[int, tuple[float, int]] = {}
        held: list[str] = []
        done = 0  # words before those held
        text, at = text or "", 0
        while at < len(text):
            stop = at + PIECE
            if stop < len(text):  # a piece ends where a word does
                m = re.compile("[^A-Za-z0-9]").search(text, stop)
                stop = m.start() if m else len(text)
            words = held + words_of(text[at:stop])
            last = stop >= len(text)
            self._piece(words, done, last and done == 0, best)
            keep = min(len(words), self.longest - 1)
            held, done, at = words[len(words) - keep :], done + len(words) - keep, stop
        return sorted(((d, p, self.rows[k][0]) for k, (d, p) in best.items()), key=lambda x: (x[1], x[2], -x[0]))

    def _piece(self, words: list[str], done: int, whole: bool, best: dict[int, tuple[float, int]]) -> None:
        if len(words) < 2:
            return
        vocab, of_pair, has = self.tables
        ids = np.fromiter((vocab.get(w, 0) for w in words), np.int64, len(words))
        gram = of_pair[ids[:-1] * (len(vocab) + 1) + ids[1:]]
        for k in np.flatnonzero(has[:, np.unique(gram)].sum(1) >= self.need):
            n = self.rows[k][1]
            if len(words) < n and not whole:
                continue  # the piece before held it
            width = min(n, len(words)) - 1
            sums = np.concatenate([[0], np.cumsum(has[k, gram])])
            for start in np.flatnonzero(sums[width:] - sums[:-width] >= self.need[k]).tolist():
                window = set(zip(words[start : start + width], words[start + 1 : start + width + 1], strict=True))
                dice = 2 * len(window & self.sets[k]) / (len(window) + len(self.sets[k]))
                if dice >= self.threshold and (k not in best or dice > best[k][0]):
                    best[k] = (dice, done + start)


def scan_licenses(df: DataFrame, keep: list[str], text: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: the ``keep`` columns, ``n_matches``, the best ``license``, its ``dice`` and ``word_no`` (from 0), and all ``matches``."""
    scanner = Scanner(templates, threshold)
    added = ["n_matches", "license", "dice", "word_no", "matches"]
    keep = [c for c in keep if c.lower() not in added]
    kinds = (LongType(), StringType(), DoubleType(), LongType(), StringType())
    schema = StructType([*df.select(*keep).schema, *(StructField(n, t) for n, t in zip(added, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for value in batch.column(len(keep)):
                    found = scanner.scan(value.as_py())
                    top = min(found, key=lambda x: (-x[0], x[1], x[2]), default=(None, None, None))
                    rows.append((len(found), top[2], None if top[0] is None else round(top[0], 6), top[1], ",".join(f"{p}:{name}" for _, p, name in found)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.string()), strict=True))], [*keep, *added])

    return df.select(*keep, text).mapInArrow(run, schema)
