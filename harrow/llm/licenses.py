"""Licence scans: texts compared to licence templates by Dice coefficient over word bigrams.

A unit is a run of consecutive lines: one line, several, or the whole text.  Text and templates are
normalised alike (A-Z lower-cased, all but a-z and 0-9 turned into spaces), so marks of comments and
line breaks do not count.  With ``a`` and ``b`` bigrams the coefficient is at most ``2 min(a, b) / (a + b)``,
so a template is compared only to runs whose size lies within ``[b t / (2 - t), b (2 - t) / t]`` for threshold
``t``, only in texts that hold as many of its bigrams as the lower bound, and only to runs that begin
and end at lines with one of its bigrams.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-header-whole": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold lies above 0 and at most at 1")
        self.threshold, self.templates = threshold, []
        self.index: dict[tuple[bytes, bytes], list[int]] = {}
        for name in sorted(templates):
            words = words_of(templates[name].encode())
            grams = Counter(zip(words, words[1:]))
            size = sum(grams.values())
            for g in grams:
                self.index.setdefault(g, []).append(len(self.templates))
            self.templates.append((name, grams, size, size * threshold / (2 - threshold), size * (2 - threshold) / threshold))

    def runs(self, text: bytes) -> list[tuple[float, int, int, str]]:
        """``(dice, first line, lines, name)`` of the runs of lines that reach the threshold."""
        words, line_of = [], []
        for i, line in enumerate(text.split(b"\n")):
            own = words_of(line)
            words += own
            line_of += [i] * len(own)
        known = self.index
        at: dict[int, list[int]] = {}
        for p, g in enumerate(zip(words, words[1:])):
            if g in known:
                for k in known[g]:
                    at.setdefault(k, []).append(p)
        found = []
        for k, places in at.items():
            name, grams, size, low, high = self.templates[k]
            if len(places) < low:
                continue
            held = Counter((words[p], words[p + 1]) for p in places)
            if sum(min(c, grams[g]) for g, c in held.items()) < low:
                continue
            found += self._of_template(name, grams, size, low, high, words, line_of, places)
        return found

    def _of_template(self, name, grams, size, low, high, words, line_of, places) -> Iterator[tuple[float, int, int, str]]:
        begins = sorted({line_of[p] for p in places})
        ends = sorted({line_of[p + 1] for p in places})
        for first in begins:
            start = bisect_left(line_of, first)
            held, done = Counter(), bisect_left(places, start)
            for last in ends[bisect_left(ends, first) :]:
                stop = bisect_right(line_of, last)  # words start to stop; bigrams start to stop - 1
                n = stop - start - 1
                if n > high:
                    break
                while done < len(places) and places[done] < stop - 1:
                    held[words[places[done]], words[places[done] + 1]] += 1
                    done += 1
                if n < max(low, 1):
                    continue
                dice = 2 * sum(min(c, grams[g]) for g, c in held.items()) / (size + n)
                if dice >= self.threshold:
                    yield dice, first, last - first + 1, name


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, score, line, n_lines, n_matched)`` of every row.

    ``line`` is the 0-based line where the best match begins and ``n_lines`` its lines; of equals the first,
    then the longest, then the first by name.  ``n_matched`` counts the lines that lie in matching runs.
    A text without match, null and empty ones included, has nulls and 0.  Repeated rows and null ids
    give rows of their own, long texts are read whole, other columns, whatever their names, are
    ignored, and an empty table gives an empty table.
    """
    matcher = Matcher(TEMPLATES if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hits = matcher.runs(text or b"")
                dice, line, n, name = min(hits, key=lambda h: (-h[0], h[1], -h[2], h[3]), default=(None, None, None, None))
                out.append((name, dice, line, n, len({k for _, a, m, _ in hits for k in range(a, a + m)})))
            if not out:
                continue
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["id", "license", "score", "line", "n_lines", "n_matched"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, license string, score double, line int, n_lines int, n_matched long").withColumnRenamed("id", id_col)
