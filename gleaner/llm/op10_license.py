"""License scans by patience alignment.

A text's words are aligned with each template's: words unique to both sides are anchors, the longest increasing
subsequence of them is kept, and the gaps between kept anchors are aligned the same way, down to equal words beside an
anchor. Where the longest run of equal words in a gap has more words than the runs around its anchors (a notice that stands
in the text twice leaves stray anchors or none), that run is kept instead. Coverage is the share of template words that are
aligned; a template is found where it reaches `least` (templates of under SHORT words: all of them) within SPREAD times its
words, so words strewn over a text don't add up to a license. Its place runs from the first to the last aligned word, and
every place counts. Before aligning, a bound is tested that no alignment exceeds (template words that a stretch holds at
all, repeats counted), so only stretches that cannot reach `least` are passed over.

Defined results: null and empty texts, and texts without any template, have an empty list and coverage 0; of several
templates found `license` names the one with most coverage, then most words, then the first by name; repeated rows are
scanned alike; an empty table gives an empty result; other columns are ignored. A text of any length is aligned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, documents, pieces

LEAST = 0.8
#: Templates of fewer words count only whole.
SHORT = 20
#: A match spans at most so many times the template's words.
SPREAD = 1.5
_DISCLAIMED = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMED = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see https://www.gnu.org/licenses/."
#: License notices by name. Short notices first, then whole short licenses and the notices that long licenses ask for.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    + _DISCLAIMED
    + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": f"{_BSD} {_BSD_DISCLAIMED}",
    "bsd-3-clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMED}",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-3.0": _GNU.format("GNU General Public License"),
    "lgpl-3.0": _GNU.format("GNU Lesser General Public License"),
    "agpl-3.0": _GNU.format("GNU Affero General Public License"),
}
WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest increasing subsequence by the second number; pairs are sorted by the first."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        tops[k : k + 1] = [b]
        ends[k : k + 1] = [i]
        back.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (text, template) with equal words, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        # Equal words count beside an anchor only; what the text itself begins or ends with may stand far from the notice.
        left, right = c > 0, d < len(template)
        while left and a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while right and a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        wanted = Counter(template[c:d])
        seen = Counter(w for w in text[a:b] if w in wanted)
        place = {w: j for j, w in enumerate(template[c:d], c) if wanted[w] == 1 and seen[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place])
        agreed = _agreed(text, template, a, b, c, d, anchors)
        if agreed < sum(min(n, seen[w]) for w, n in wanted.items()):
            # A notice that stands twice leaves no unique words, or only stray ones: its longest run goes before them.
            run = _longest_run(text, template, a, b, c, d)
            anchors = run if len(run) > agreed else anchors
        if anchors:
            out.extend(anchors)
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            todo.extend((x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False))
    return sorted(out)


def _agreed(text: list[str], template: list[str], a: int, b: int, c: int, d: int, anchors: list[tuple[int, int]]) -> int:
    """Template words in runs of equal words around the anchors."""
    done: set[int] = set()
    for i, j in anchors:
        if j not in done:
            n = 0
            while i + n < b and j + n < d and text[i + n] == template[j + n]:
                done.add(j + n)
                n += 1
            n = 1
            while i - n >= a and j - n >= c and text[i - n] == template[j - n]:
                done.add(j - n)
                n += 1
    return len(done)


def _longest_run(text: list[str], template: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """The longest run of equal words (the first of several), as pairs of places."""
    places: dict[str, list[int]] = {}
    for j in range(c, d):
        places.setdefault(template[j], []).append(j)
    best, pick, ends = 0, (a, c), {}
    for i in range(a, b):
        now = {}
        for j in places.get(text[i], ()):
            n = now[j] = ends.get(j - 1, 0) + 1
            if n > best:
                best, pick = n, (i - n + 1, j - n + 1)
        ends = now
    return [(pick[0] + n, pick[1] + n) for n in range(best)]


def places(words: list[str], wanted: list[str], least: float) -> list[tuple[int, int, int]]:
    """(begin, end, matched words) of a template's places in words, which don't overlap; the best one first.

    A place spans at most SPREAD times the template's words. Stretches that hold any such span whole are aligned, if they
    hold enough of the template's words at all.
    """
    size, need = len(wanted), least * len(wanted)
    have = set(wanted)
    count = np.concatenate([[0], np.cumsum(np.fromiter((w in have for w in words), dtype=np.int64, count=len(words)))])
    if count[-1] < need:
        return []
    most = max(size, int(SPREAD * size))
    step = max(1, most // 2)
    begin = np.arange(0, len(words), step)
    total = Counter(wanted)
    found = []
    for a in begin[count[np.minimum(begin + most + step, len(words))] - count[begin] >= need].tolist():
        part = words[a : a + most + step]
        seen = Counter(w for w in part if w in have)
        if sum(min(n, seen[w]) for w, n in total.items()) >= need:
            pairs = align(part, wanted)
            if len(pairs) >= need and pairs[-1][0] + 1 - pairs[0][0] <= most:
                found.append((a + pairs[0][0], a + pairs[-1][0] + 1, len(pairs)))
    out: list[tuple[int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (-x[2], x[1] - x[0], x[0])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in out):
            out.append(x)
    return out


def scan(text: str, templates: dict[str, list[str]], least: float = LEAST) -> list[dict]:
    """Each place of a template in text: name, coverage, first and last aligned word."""
    words = words_of(text)
    out = []
    for name, wanted in templates.items():
        for begin, end, matched in places(words, wanted, least if len(wanted) >= SHORT else 1.0):
            out.append({"name": name, "coverage": matched / len(wanted), "begin": begin, "end": end, "matched": matched})
    return sorted(out, key=lambda x: (-x["coverage"], -x["matched"], x["name"], x["begin"]))


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Per row: key, license, coverage, n_found, found (name, coverage, begin, end, matched)."""
    bounded_batches(df.sparkSession)
    wanted = {k: words_of(v) for k, v in sorted((templates or TEMPLATES).items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64()), ("matched", pa.int64())]))
        for batch in (p for b in batches for p in pieces(b)):
            found = [scan(x or "", wanted, least) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([x[0]["name"] if x else None for x in found], pa.string()),
                    pa.array([x[0]["coverage"] if x else 0.0 for x in found], pa.float64()),
                    pa.array(np.array([len(x) for x in found], dtype=np.int64)),
                    pa.array(found, kind),
                ],
                ["key", "license", "coverage", "n_found", "found"],
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, license string, coverage double, n_found long, found array<struct<name: string, coverage: double, begin: long, end: long, matched: long>>"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
