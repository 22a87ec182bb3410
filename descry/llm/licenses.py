"""License scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

Each template is cut into units of at most UNIT words; a text is looked at in overlapping windows of
each unit's length, at every word. Signatures of 64 minima over 5-word shingles are cut into 32 bands of 2
rows. A text shorter than the unit is one window. A window that contains 0.8 of a unit's shingles has a
Jaccard similarity of 2/3 or more with it (it is no longer than the unit) and shares a band with probability 1 - (1 - (2/3)**2)**32, over
0.999999993. A window without any shingle of a template has an empty intersection and is passed
over before its signature is made. Candidates are verified by exact containment of word shingles.
A template counts as found if units with 0.8 of its shingles are.

Null text: as empty, nothing found. Null doc_id: kept. Repeated rows: one result each. Extra
columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import LOWER, Member, Words, chunks, mix, texts_of

SHINGLE, CONTAINED = 5, 0.8
BANDS, ROWS = 32, 2
UNIT = 64
#: Digits, a-z and all beyond ASCII make words.
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])

#: Fixed texts: grants, notices and disclaimers as their authors publish them for a file's head or a
#: license file, without the line that names the holder, and one-line statements. Licenses that run
#: to pages are known by the notice that their authors ask for.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
TEMPLATES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-clause": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version. " + _GNU_WARRANTY + "See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. " + _GNU_WARRANTY + "See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. " + _GNU_WARRANTY + "See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. " + _GNU_WARRANTY.replace("program", "library") + "See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to https://unlicense.org"
    ),
}


def words_of(texts: list[bytes]) -> Words:
    return Words([t.translate(LOWER) for t in texts], IS_WORD)


def shingles(words: list[bytes], k: int = SHINGLE) -> set[tuple]:
    """All runs of k words; the whole if there are fewer."""
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


_rng = np.random.default_rng(20_240_117)
MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the shingle hashes' MinHash signature."""
    least = mix(hashes[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(1).reshape(BANDS, ROWS)
    return mix(least[:, 0] * np.uint64(0x9E3779B97F4A7C15) + least[:, 1] + np.arange(BANDS, dtype=np.uint64))


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.units: list[tuple[str, int, set[tuple]]] = []  # name, words, shingles
        self.size: dict[str, int] = {}
        self.index: dict[int, list[int]] = {}
        hashes = []
        for name, text in texts.items():
            w = words_of([text.encode()])
            n = len(w.start)
            if n < SHINGLE:
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            parts = max(1, round(n / UNIT))
            cuts = [n * i // parts for i in range(parts + 1)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = w.joined(a, b - a).split()
                h = w.grams(SHINGLE)[a : b - SHINGLE + 1]
                hashes.append(h)
                for key in bands(h).tolist():
                    self.index.setdefault(key, []).append(len(self.units))
                self.units.append((name, b - a, shingles(own)))
                self.size[name] = self.size.get(name, 0) + len(self.units[-1][2])
        self.member = Member(np.concatenate(hashes))
        self.lengths = sorted({n for _, n, _ in self.units})

    def find(self, w: Words) -> Iterator[tuple[int, int, int, float]]:
        """(text, first word, unit, containment) of the best window of each run of windows that holds a unit."""
        text, grams = w.text_of_word(), w.grams(SHINGLE)
        hits = self.member.find(grams)
        hits = hits[text[hits] == text[hits + SHINGLE - 1]] if len(hits) else hits
        if not len(hits):
            return
        short = np.unique(text[hits])
        for size in self.lengths:
            for t in short[w.count[short] < size].tolist():
                a, n = int(w.first[t]), int(w.count[t])
                near = {u for k in bands(grams[a : a + n - SHINGLE + 1]).tolist() for u in self.index.get(k, ()) if self.units[u][1] == size}
                if not near:
                    continue
                own = shingles(w.joined(a, n).split())
                for u in near:
                    share = len(own & self.units[u][2]) / len(self.units[u][2])
                    if share >= CONTAINED:
                        yield t, a, u, share
            inside = size - SHINGLE  # a window from a on has the shingles a .. a + inside
            starts = np.unique((hits[:, None] - np.arange(inside + 1)[None, :]).ravel())
            starts = starts[starts >= 0]
            starts = starts[starts + size <= len(text)]
            starts = starts[text[starts] == text[starts + size - 1]]
            best: dict[int, tuple[int, int, float]] = {}  # unit: last window, best window, its containment
            for a in starts.tolist():
                keys = bands(grams[a : a + inside + 1]).tolist()
                near = {u for k in keys for u in self.index.get(k, ()) if self.units[u][1] == size}
                if not near:
                    continue
                own = shingles(w.joined(a, size).split())
                for u in near:
                    share = len(own & self.units[u][2]) / len(self.units[u][2])
                    if share < CONTAINED:
                        continue
                    # A window that shares no word with the best one, or no text, is of another copy.
                    if u in best and (a - best[u][1] >= size or text[best[u][1]] != text[a]):
                        yield int(text[best[u][1]]), best[u][1], u, best[u][2]
                        del best[u]
                    last = best.get(u)
                    best[u] = (a, a, share) if last is None or share > last[2] else (a, last[1], last[2])
            for u, (_, a, share) in best.items():
                yield int(text[a]), a, u, share


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """id, n_licenses, licenses (names, sorted, comma-joined) and spans (name:first word:words:containment per unit, by place)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts_by_name = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(texts_by_name)
        for batch in batches:
            texts = texts_of(batch, "text")
            found: list[list] = [[] for _ in texts]
            for lo, hi in chunks(texts):
                w = words_of(texts[lo:hi])
                for t, a, u, share in index.find(w):
                    at = a - int(w.first[t])
                    found[lo + t].append((at, u, share, min(index.units[u][1], int(w.count[t]) - at)))
            names, spans = [], []
            for f in found:
                held: dict[str, dict[int, float]] = {}
                for _, u, share, _ in f:
                    of = held.setdefault(index.units[u][0], {})
                    of[u] = max(of.get(u, 0.0), share)
                whole = {n for n, us in held.items() if sum(s * len(index.units[u][2]) for u, s in us.items()) >= CONTAINED * index.size[n]}
                names.append(sorted(whole))
                spans.append(",".join(f"{index.units[u][0]}:{a}:{n}:{share:.3f}" for a, u, share, n in sorted(f) if index.units[u][0] in whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, names), pa.int64()), pa.array([",".join(n) for n in names], pa.string()), pa.array(spans, pa.string())], names=["id", "n_licenses", "licenses", "spans"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("spans", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
