"""License scans: known licence sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Words outside a rule that may stand between two of its sentences (list numbers, comment marks, names).
GAP = 12
#: Ordered rules: name, licence identifier, the sentences that must follow on each other, and how many words may
#: stand between two of them if not ``GAP``.  Words are compared with case folded and punctuation ignored.
#: Long licences are known by sentences of their beginning.
RULES: list[tuple] = [
    ("mit-notice-released", "MIT", ["Released under the MIT License."]),
    ("mit-notice-licensed", "MIT", ["Licensed under the MIT License."]),
    ("mit-notice-project", "MIT", ["This project is licensed under the MIT License."]),
    (
        "mit-text",
        "MIT",
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
            "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ],
    ),
    (
        "isc-text",
        "ISC",
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ],
    ),
    ("apache-notice", "Apache-2.0", ["Licensed under the Apache License, Version 2.0."]),
    (
        "apache-header",
        "Apache-2.0",
        [
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
            "See the License for the specific language governing permissions and limitations under the License.",
        ],
    ),
    (
        "bsd-2-clause-text",
        "BSD-2-Clause",
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ],
    ),
    (
        "bsd-3-clause-text",
        "BSD-3-Clause",
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ],
    ),
    ("gpl-3-notice", "GPL-3.0", ["This work is licensed under the GNU General Public License, version 3."]),
    (
        "gpl-3-header",
        "GPL-3.0-or-later",
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.",
        ],
    ),
    (
        "gpl-2-header",
        "GPL-2.0-or-later",
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.",
        ],
    ),
    ("mpl-2-header", "MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
    ("unlicense-text", "Unlicense", ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0."]),
    ("cc-by-4-notice", "CC-BY-4.0", ["Licensed under CC BY 4.0."]),
    ("cc-by-4-long", "CC-BY-4.0", ["This work is licensed under a Creative Commons Attribution 4.0 International License."]),
    ("cc-by-sa-4-notice", "CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0."]),
    ("cc0-notice", "CC0-1.0", ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]),
    (
        "isc-text-full",
        "ISC",
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
            "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ],
    ),
    (
        "zero-clause-bsd-text",
        "0BSD",
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ],
    ),
    (
        "bsd-liability",
        "BSD-style",
        [
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        ],
    ),
    (
        "apache-2-text",
        "Apache-2.0",
        [
            "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
            "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
            "\"You\" (or \"Your\") shall mean an individual or Legal Entity exercising permissions granted by this License.",
            "\"Source\" form shall mean the preferred form for making modifications, including but not limited to software source code, documentation source, and configuration files.",
            "\"Contributor\" shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor and subsequently incorporated within the Work.",
        ],
        400,
    ),
    (
        "gpl-3-text",
        "GPL-3.0",
        [
            "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
            "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
            "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        ],
    ),
    (
        "gpl-2-text",
        "GPL-2.0",
        [
            "The licenses for most software are designed to take away your freedom to share and change it.",
            "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        ],
    ),
    ("agpl-3-text", "AGPL-3.0", ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."]),
    (
        "agpl-3-header",
        "AGPL-3.0-or-later",
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU Affero General Public License for more details.",
        ],
    ),
    ("lgpl-3-text", "LGPL-3.0", ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."]),
    (
        "lgpl-3-header",
        "LGPL-3.0-or-later",
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU Lesser General Public License for more details.",
        ],
    ),
    (
        "lgpl-2.1-header",
        "LGPL-2.1-or-later",
        [
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU Lesser General Public License for more details.",
        ],
    ),
    ("epl-2-notice", "EPL-2.0", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]),
    (
        "zlib-text",
        "Zlib",
        [
            "This software is provided 'as-is', without any express or implied warranty.",
            "In no event will the authors be held liable for any damages arising from the use of this software.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
            "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
            "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
            "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
            "This notice may not be removed or altered from any source distribution.",
        ],
    ),
    (
        "unlicense-text-full",
        "Unlicense",
        [
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
            "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
            "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
            "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        ],
    ),
    ("cc-by-sa-4-long", "CC-BY-SA-4.0", ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]),
    ("cc-by-nc-4-long", "CC-BY-NC-4.0", ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]),
]


def _ends(data: np.ndarray) -> np.ndarray:
    """Mask of bytes that end a sentence: . ! ? : before white space or the end."""
    stop = np.isin(data, np.frombuffer(b".!?:", np.uint8))
    gap = np.ones(len(data), bool)
    gap[:-1] = np.isin(data[1:], np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8))
    return stop & gap


def _spans(group, row, h):
    """(first word, words, hash) of the runs of words with equal (row, group)."""
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])])
    size = np.diff(np.r_[first, len(row)])
    up, _ = K.powers(K._Q, int(size.max()) + 1)
    k = np.arange(len(row)) - np.repeat(first, size)
    return first, size, K.mix(np.add.reduceat(h * up[k], first) + size.astype(np.uint64))


def sentences(texts: pa.Array):
    """Pieces (lo, row, place, end, hash): sentences of every text, place and end counting words.

    A text is cut at sentence ends and line breaks, and once more at sentence ends
    alone, as licence texts are often wrapped; what both cuts yield counts once.
    """
    table = K.fold_table("alnum")
    data, offs = K.buffer(texts)
    for lo, hi in K.pieces(offs):
        own = data[offs[lo] : offs[hi]]
        row, s, _, h = K.words(own, offs[lo : hi + 1] - offs[lo], table)
        if not len(row):
            continue
        stops = np.flatnonzero(_ends(own))
        breaks = np.flatnonzero((own == 10) | (own == 13))
        a = np.searchsorted(stops, s)
        b = np.searchsorted(breaks, s)
        begin = np.searchsorted(row, np.arange(hi - lo))
        wide, narrow = _spans(a, row, h), _spans(a + b, row, h)
        first, size, key = (np.concatenate(x) for x in zip(wide, narrow))
        o = np.lexsort((size, first))
        first, size, key = first[o], size[o], key[o]
        new = np.r_[True, (first[1:] != first[:-1]) | (size[1:] != size[:-1])]
        first, size, key = first[new], size[new], key[new]
        r = row[first]
        yield lo, r, first - begin[r], first - begin[r] + size, key


class Rules:
    """Rules as sequences of sentence identifiers."""

    def __init__(self, rules=RULES, gap: int = GAP):
        self.ids: dict[int, int] = {}
        self.names, self.sequences, self.gaps = [], [], []
        for name, licence, parts, *own in rules:
            self.gaps.append(own[0] if own else gap)
            if not parts:
                raise ValueError(f"rule {name} has no sentences")
            seq = []
            for part in parts:
                # a rule's sentence may hold what a text's cut would take apart
                for _, _, _, _, key in _whole(part):
                    seq.append(self.ids.setdefault(int(key), len(self.ids)))
            self.names.append((name, licence))
            self.sequences.append(tuple(seq))
        self.keys = np.array(sorted(self.ids), np.uint64)
        self.of_key = np.array([self.ids[int(k)] for k in self.keys], np.int64)
        self.by_first: dict[int, list[int]] = {}
        for i, seq in enumerate(self.sequences):
            self.by_first.setdefault(seq[0], []).append(i)

    def match(self, found):
        """(rule, start, end) over one text's known sentences [(place, end, id)], in order of place.

        The sentences of a rule come in order, each beginning at or after the end of
        the one before, with at most the rule's gap of other words between; of several
        such sentences the one that ends first counts.
        """
        at: dict[int, list[tuple[int, int]]] = {}
        for place, end, i in found:
            at.setdefault(i, []).append((place, end))
        out = set()
        for place, end, i in found:
            for rule in self.by_first.get(i, ()):
                stop = end
                for nxt in self.sequences[rule][1:]:
                    places = at.get(nxt, [])
                    # places of one sentence ascend, and so do their ends
                    k = bisect.bisect_left(places, (stop, 0))
                    if k == len(places) or places[k][0] > stop + self.gaps[rule]:
                        break
                    stop = places[k][1]
                else:
                    out.add((rule, place, stop))
        return sorted(out)


def _whole(part: str):
    data, offs = K.buffer(pa.array([part.replace("\n", " ")]))
    row, s, _, h = K.words(data, offs, K.fold_table("alnum"))
    first, size, key = _spans(np.searchsorted(np.flatnonzero(_ends(data)), s), row, h)
    return [(0, 0, 0, 0, k) for k in key]


def licence_matches(docs: DataFrame, rules=RULES, gap: int = GAP) -> DataFrame:
    """(doc_id, rule, licence, start_word, end_word): places where an ordered licence rule holds.

    Words are runs of letters and digits with ASCII case folded, counted from 0;
    end_word is exclusive.  A document may match several rules, also inside one
    another.  One row for each distinct match.  ``gap`` is the number of words that may
    stand between two sentences of a rule that names none itself.

    Rows with a null doc_id are left out; null, empty and wordless texts match
    nothing; repeated rows give their matches once; long texts are scanned whole; of
    equal next sentences the first counts.  An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    known = Rules(rules, gap)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out = []
            for lo, row, place, end, key in sentences(batch.column(1)):
                k = np.minimum(np.searchsorted(known.keys, key), len(known.keys) - 1)
                hit = np.flatnonzero(known.keys[k] == key) if len(known.keys) else []
                own: dict[int, list] = {}
                for j in hit:
                    own.setdefault(int(row[j]), []).append((int(place[j]), int(end[j]), int(known.of_key[k[j]])))
                for r, found in own.items():
                    for rule, a, b in known.match(found):
                        out.append((int(ids[lo + r]), *known.names[rule], a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "rule", "licence", "start_word", "end_word"])

    return texts.mapInArrow(scan, "doc_id long, rule string, licence string, start_word int, end_word int").distinct()


def brute_matches(text: str, rules=RULES, gap: int = GAP) -> set[tuple[str, int, int]]:
    """(rule, start_word, end_word) of one text by plain string work (for tests)."""

    def words(x):
        return tuple(re.findall(rb"[0-9a-z\x80-\xff]+", x.encode().lower()))

    def cut(x, pattern):
        at, out = 0, []
        for part in re.split(pattern, x):
            w = words(part)
            if w:
                out.append((at, at + len(w), w))
            at += len(w)
        return out

    ends = r"(?<=[.!?:])[ \t\r\n\x0b\x0c]+"
    spans = set(cut(text, ends)) | set(cut(text, ends + r"|[\r\n]+"))
    out = set()
    for name, _, parts, *own in rules:
        most = own[0] if own else gap
        seq = [w for part in parts for _, _, w in cut(part.replace("\n", " "), ends)]
        states = [(a, b) for a, b, w in spans if w == seq[0]]
        for start, stop in states:
            for want in seq[1:]:
                later = [b for a, b, w in spans if w == want and stop <= a <= stop + most]
                if not later:
                    break
                stop = min(later)
            else:
                out.add((name, start, stop))
    return out
