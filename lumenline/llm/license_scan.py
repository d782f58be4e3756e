"""License scans by conditional compression.

Words within reach of a cue (a word of licenses) are a candidate region, whatever lines they stand on; templates whose words
a region lacks are passed over, which loses none.  Stretches of it that a template may stand in are candidate blocks, those
that overlap as one.  A block's words are compressed by zstandard alone and once more with each template as a raw dictionary, and the
templates are ranked by how much shorter they make it.  Down that ranking, a template is confirmed by its exact wording: nearly all its
words in order, and all its numbers.  The first that is confirmed has its place; those after it have what is left of the block.

Defined cases: null and empty texts have no regions; a row's block is the text from the span's first to its last word; a
region that no template is confirmed in has a row with a null license only if ``unconfirmed`` is set.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Public license notices, the opening and whole bodies of short licenses, and the notices that long ones ask for.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED "
        'BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        'without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license "
        "grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and "
        "all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
        'object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON- "
        "INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        'provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND '
        "THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "EUPL-1.2": (
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the "
        'EUPL (the "Licence"); You may not use this work except in compliance with the Licence.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "PostgreSQL": (
        "Released under the PostgreSQL License.",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a "
        "written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two "
        "paragraphs appear in all copies. IN NO EVENT SHALL THE AUTHORS BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, "
        "OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE "
        "AUTHORS HAVE BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. THE AUTHORS SPECIFICALLY DISCLAIM ANY WARRANTIES, INCLUDING, BUT "
        "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER "
        'IS ON AN "AS IS" BASIS, AND THE AUTHORS HAVE NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.',
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non- "
        "commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
        "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at "
        "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        'perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered "
        "source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice "
        "may not be removed or altered from any source distribution.",
    ),
}
#: Words near one of these are candidates; every template has one.
CUES = re.compile(r"licen[sc]|copyright|©|permission|permitted|warrant|redistribut|public\W+domain|released\W+under|creative\W+commons|merchantab|as\W+is\b", re.I)
#: A word goes on after a hyphen at the end of a line, behind the next line's comment marks.
WORDS = re.compile(r"\w+(?:(?:[-.]|-\s*\n\W*)\w+)*")
BROKEN = re.compile(r"(?<=-)\W+")
#: The share of a template's words that must stand in the span.
COVERAGE = 0.9
LEVEL = 3
RESULT = "start_line int, n_lines int, block string, license string, template int, reduction double, n_missing int, n_extra int, differences string"


def words_of(text: str) -> list[str]:
    return [BROKEN.sub("", w) for w in WORDS.findall(text.lower())]


class Templates:
    """Templates made ready: their words, and a compressor with each as a raw dictionary."""

    def __init__(self, texts: Mapping[str, Sequence[str]]):
        self.all: list[tuple[str, int, list[str], Counter[str], zstandard.ZstdCompressor]] = []
        for name, own in sorted(texts.items()):
            for i, t in enumerate(own):
                words = words_of(t)
                raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)
                self.all.append((name, i, words, Counter(words), packer))
        self.longest = max((len(w) for _, _, w, *_ in self.all), default=0)

    def rank(self, block: Sequence[str], among: Iterable[int] | None = None) -> list[tuple[float, int]]:
        """(reduction, place in ``all``) of each template, or of those ``among``, best first; ties by name.

        A block is its words, so line breaks and comment marks don't count.
        """
        data = " ".join(block).encode()
        alone = len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(data))
        places = range(len(self.all)) if among is None else among
        return sorted(((1 - len(self.all[k][4].compress(data)) / alone, k) for k in places), key=lambda x: (-x[0], x[1]))


@lru_cache(4)
def _ready(texts: tuple[tuple[str, tuple[str, ...]], ...] | None) -> Templates:
    return Templates(TEMPLATES if texts is None else dict(texts))


def candidate_regions(text: str | None, longest: int | None = None) -> list[list[re.Match]]:
    """The words of each region: all within reach of a cue, twice the longest template, on both sides."""
    if not text or not CUES.search(text):
        return []
    reach = 2 * (_ready(None).longest if longest is None else longest)
    words = list(WORDS.finditer(text))
    starts = [w.start() for w in words]
    out: list[list[int]] = []
    for cue in CUES.finditer(text):
        at = bisect_right(starts, cue.start())
        low, high = max(0, at - reach), min(len(words), at + reach)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [words[a:b] for a, b in out if a < b]


def rank(block: str) -> list[tuple[float, str, int, list[str]]]:
    """(reduction, license, template, words) of each of ``TEMPLATES``, best first."""
    ready = _ready(None)
    return [(r, *ready.all[k][:3]) for r, k in ready.rank(words_of(block))]


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """The template's words that the block lacks, and the block's words between the first and the last that they share."""
    ops = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    while ops and ops[0][0] == "insert":
        ops = ops[1:]
    while ops and ops[-1][0] == "insert":
        ops = ops[:-1]
    missing = [w for o, a, b, _, _ in ops if o in ("delete", "replace") for w in template[a:b]]
    extra = [w for o, _, _, a, b in ops if o in ("insert", "replace") for w in block[a:b]]
    return missing, extra


def _costs(template: list[int], region: np.ndarray) -> np.ndarray:
    """For each end in the region the least cost of a span that the template stands in: len + 1 a missing word, 1 an extra one."""
    missing, n = len(template) + 1, len(region) + 1
    place = np.arange(n)
    row = np.zeros(n, np.int64)
    for w in template:
        base = row + missing
        base[1:] = np.minimum(base[1:], np.where(region == w, row[:-1], base[1:]))
        row = np.minimum.accumulate(base - place) + place
    return row


def _spans(template: list[int], region: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the region that can hold the template, best first, none over another."""
    n = len(template)
    most = (n + 1) * int((1 - COVERAGE) * n + 1e-9) + n
    costs = _costs(template, region)
    ends = np.nonzero((costs[1:] <= most) & (costs[1:] <= costs[:-1]))[0] + 1
    out: list[tuple[int, int]] = []
    for end in ends[np.argsort(costs[ends], kind="stable")].tolist():
        if any(a < end <= b for a, b in out):
            continue
        low = max(0, end - 2 * n)
        back = _costs(template[::-1], region[low:end][::-1] if end > low else region[:0])
        # the template's last word stands at the span's end, so the span is the shortest of the least cost
        start = end - int(np.argmin(back))
        if start < end and not any(a < end and start < b for a, b in out):
            out.append((start, end))
    return out


def _blocks(spans: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, template) that overlap, directly or through others, as one block each."""
    out: list[list[tuple[int, int, int]]] = []
    reach = -1
    for span in sorted(spans):
        if span[0] >= reach:
            out.append([])
        out[-1].append(span)
        reach = max(reach, span[1])
    return out


def confirmed(template: list[str], words: list[str]) -> tuple[list[str], list[str]] | None:
    """The differences in wording, or None if there are too many or a number is missing."""
    missing, extra = differences(template, words)
    digits = any(c.isdigit() for w in missing for c in w)
    return None if len(missing) > (1 - COVERAGE) * len(template) + 1e-9 or len(extra) > len(template) or digits else (missing, extra)


def notices(text: str, region: list[re.Match], ready: Templates | None = None) -> list[tuple[int, int, str, int, float, int, int, str]]:
    """(start, end, license, template, reduction, n_missing, n_extra, differences) of each confirmed notice, by place."""
    ready = ready or _ready(None)
    words = [BROKEN.sub("", w.group().lower()) for w in region]
    counts = Counter(words)
    ids = {w: k for k, w in enumerate(counts)}
    coded = np.array([ids[w] for w in words])
    spans = []
    for k, (_, _, template, needed, _) in enumerate(ready.all):
        if sum(min(m, counts[w]) for w, m in needed.items()) >= COVERAGE * len(template) - 1e-9:
            spans += [(a, b, k) for a, b in _spans([ids.get(w, -1) for w in template], coded)]
    out = []
    for block in _blocks(spans):
        begin, end = block[0][0], max(b for _, b, _ in block)
        taken: list[tuple[int, int]] = []
        for reduction, k in ready.rank(words[begin:end], {k for _, _, k in block}):
            name, i, template, *_ = ready.all[k]
            for a, b, _ in (s for s in block if s[2] == k):
                if not any(a < y and x < b for x, y in taken) and (found := confirmed(template, words[a:b])) is not None:
                    taken.append((a, b))
                    said = " ".join([*(f"-{w}" for w in found[0]), *(f"+{w}" for w in found[1])])
                    out.append((region[a].start(), region[b - 1].end(), name, i, reduction, len(found[0]), len(found[1]), said))
    return sorted(out)


def scan(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", unconfirmed: bool = False, templates: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row for each confirmed notice: ``id_col`` and the columns of ``RESULT``.

    ``templates`` has the texts of each license, whole bodies or notices, instead of ``TEMPLATES``; they are sent to all tasks.
    """
    texts = None if templates is None else tuple((name, tuple(own)) for name, own in sorted(templates.items()))
    kind = dict(df.dtypes)[id_col]
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.string())
    names = [x.split(" ")[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _ready(texts)
        for b in batches:
            places, rows = [], []
            for i, t in enumerate(b.column(1)):
                said = t.as_py()
                for region in candidate_regions(said, ready.longest):
                    found = notices(said, region, ready)
                    if not found and unconfirmed and ready.all:
                        start, end = region[0].start(), region[-1].end()
                        found = [(start, end, None, None, ready.rank(words_of(said[start:end]))[0][0], None, None, None)]
                    for start, end, *rest in found:
                        places.append(i)
                        rows.append((said.count("\n", 0, start), said.count("\n", start, end) + 1, said[start:end], *rest))
            if rows:
                cols = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), *cols], names=[id_col, *names])

    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")
