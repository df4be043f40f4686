"""Licence scan: matching statistics against a generalised suffix automaton of licence words, chained into spans.

The automaton holds every template, notice and phrase below as sequences of word numbers. A text is streamed through it
once; at each word it knows the longest match with any template that ends there. Maximal matches of enough words are
chained per template (in order in text and template, with small gaps), and a chain that covers enough of its template
gives the template's label. Phrases are templates too: they occur where their state is a suffix of the current match.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keyloom.llm.common import alnum_words, slices

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices, heads of public licence texts, and whole texts of short public licences, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Licensed under the BSD License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    # whole texts
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-2-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib-text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("apache-2.0-text", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
)

#: Words of a match that counts for chaining, words a chain may skip on either side, share of a template to be covered.
MIN_MATCH = 3
MAX_GAP = 4
MIN_COVER = 0.75


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers; states are numbers, 0 the root."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the shorter strings that reach it from ``state`` and its suffixes."""
        copy = self._state(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[int], template: int) -> None:
        last = 0
        for position, word in enumerate(words):
            target = self.step[last].get(word)
            if target is not None:
                last = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
            else:
                new, at = self._state(self.length[last] + 1, {}, 0), last
                while at >= 0 and word not in self.step[at]:
                    self.step[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    target = self.step[at][word]
                    self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
                last = new
            self.ends[last].add((template, position))

    def finish(self) -> None:
        """Every state gets the ends of the longer strings that it is a suffix of."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def matches(self, words: list[int]):
        """Yields (position, state, matched words) for each word: the matching statistics."""
        state = matched = 0
        for position, word in enumerate(words):
            while state and word not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.step[state]:
                state, matched = self.step[state][word], matched + 1
            else:
                state = matched = 0
            yield position, state, matched


class Scanner:
    """The automaton of all templates and phrases, and what a text has of them."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates] + list(phrases.values())
        texts = [alnum_words(text) for _, text in templates] + [alnum_words(p) for p in phrases]
        self.base_from = len(templates)
        self.numbers: dict[bytes, int] = {}
        numbered = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words] for words in texts]
        self.sizes = list(map(len, numbered))
        self.automaton = Automaton()
        for template, words in enumerate(numbered):
            self.automaton.add(words, template)
        self.automaton.finish()
        own = self.automaton
        # phrase states, and for every state the phrases that end wherever its strings do
        phrase_at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for template in range(self.base_from, len(self.sizes)):
            *_, (_, state, matched) = own.matches(numbered[template])
            phrase_at[state].append((template, matched))
        self.outputs = [phrase_at.get(s, []) for s in range(len(own.length))]
        for state in sorted(range(1, len(own.length)), key=own.length.__getitem__):
            self.outputs[state] = self.outputs[state] + self.outputs[own.link[state]] if own.link[state] else self.outputs[state]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, float], list[tuple[int, int, int]]]:
        """Base places (start, template), the best cover of each template, and all covered spans (template, start, end)."""
        known = self.numbers.get
        ids = np.fromiter((known(w, 0) for w in words), np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        base: list[tuple[int, int]] = []
        anchors: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        own = self.automaton
        for first, end in edges.reshape(-1, 2).tolist():
            if end - first < 2:
                continue
            before = (0, 0, 0)
            for position, state, matched in own.matches(ids[first:end].tolist()):
                for template, size in self.outputs[state]:
                    if matched >= size:
                        base.append((first + position - size + 1, template))
                if matched <= before[2]:
                    self._anchor(anchors, first, *before)
                before = (position, state, matched)
            self._anchor(anchors, first, *before)
        cover, spans = {}, []
        for template, found in anchors.items():
            best, places = self._chains(found, MIN_COVER * self.sizes[template])
            cover[template] = best / self.sizes[template]
            spans += [(template, *place) for place in places]
        for start, template in base:
            cover[template] = 1.0
        return base, cover, spans

    def _anchor(self, anchors, first: int, position: int, state: int, matched: int) -> None:
        """Notes a match that can't be made longer, in every template that has it."""
        if matched >= MIN_MATCH:
            for template, at in self.automaton.ends[state]:
                if template < self.base_from:
                    anchors[template].append((first + position - matched + 1, at - matched + 1, matched))

    @staticmethod
    def _chains(found: list[tuple[int, int, int]], least: float) -> tuple[int, list[tuple[int, int]]]:
        """The most template words that a chain of matches in order with small gaps covers, and the places (start, end) of
        the chains that cover ``least`` words: those that don't overlap and cover the most words in all."""
        best: list[tuple[int, int]] = []
        low = 0
        for k, (text_at, at, size) in enumerate(found):
            covered, start = size, text_at
            while found[low][0] + found[low][2] + MAX_GAP < text_at and low < k:
                low += 1
            for j in range(low, k):
                t, a, s = found[j]
                skip, jump = text_at - (t + s), at - (a + s)
                if -s < skip <= MAX_GAP and -s < jump <= MAX_GAP and at > a and text_at > t and best[j][0] + size + min(0, jump) > covered:
                    covered, start = best[j][0] + size + min(0, jump), best[j][1]
            best.append((covered, start))
        # of chains by end, those that cover most together: total[k] is for the first k
        ends = [t + s for t, _, s in found]
        total, taken = [0], []
        for k, (covered, start) in enumerate(best):
            before = bisect_right(ends, start, 0, k)
            taken.append(before if covered >= least and total[before] + covered > total[k] else None)
            total.append(total[k] if taken[k] is None else total[before] + covered)
        places, k = [], len(found)
        while k:
            if taken[k - 1] is None:
                k -= 1
            else:
                places.append((best[k - 1][1], ends[k - 1]))
                k = taken[k - 1]
        return max(covered for covered, _ in best), places[::-1]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, base places and labels, all labels, the best cover, and the spans (label, first, end word).

    Null texts have no words: score 0, no labels, null places. Rows are scored one by one, so repeats repeat.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,end:int>>"
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span_type)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches):
        scanner = Scanner()
        for part in slices(batches):
            rows = []
            for text in part.column(1).to_pylist():
                words = alnum_words(text)
                base, cover, spans = scanner.scan(words)
                starts = [s for s, _ in base]
                base_labels = {scanner.labels[t] for _, t in base}
                labels = base_labels | {scanner.labels[t] for t, _, _ in spans}
                told = [{"label": scanner.labels[t], "first": s, "end": e} for t, s, e in sorted(spans, key=lambda x: x[1:])]
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(1.0, max(cover.values(), default=0.0)), told))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)
