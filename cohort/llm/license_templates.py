"""License scans by template-markup matching.

Templates hold mandatory wording, optional regions `<<optional>> ... <<end>>` and replaceable regions `<<var n>>`, which stand
for up to n words. They are compiled into automata over words; a text is accepted at a place where all mandatory
wording follows word for word. Automata run as sets of states, so a text is read once whatever it repeats.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from cohort.llm.common import map_texts, once

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")   # on lower-cased UTF-8
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
FIELDS = """n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,
    matches array<struct<template: string, label: string, start: long, stop: long>>"""

# Wording of public licenses and of the notices that name them.
TEMPLATES = {
    "mit": ("mit", """<<optional>>The MIT License (MIT) <<end>><<optional>>Copyright (c) <<var 20>><<end>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>>(including the next paragraph) <<end>>shall be
        included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE."""),
    "isc": ("isc", """<<optional>>ISC License <<end>><<optional>>Copyright (c) <<var 20>><<end>>
        Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 8>> BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    # with or without the clause on names: three clauses or two
    "bsd": ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: <<optional>>1. <<end>>Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. <<optional>>2. <<end>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        <<optional>>3. <<end>><<optional>>Neither the name of <<var 12>> nor the names of <<var 3>> contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. <<end>>
        THIS SOFTWARE IS PROVIDED BY <<var 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL <<var 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE."""),
    "zlib": ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the
        authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to
        use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
        subject to the following restrictions: <<optional>>1. <<end>>The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. <<optional>>2. <<end>>
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. <<optional>>3. <<end>>This notice may not be removed or altered from any source distribution."""),
    "unlicense": ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to
        copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright
        laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
        domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
        rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    "apache-header": ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at <<var 10>> Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    "apache-title": ("apache", """Apache License Version 2.0, January 2004 <<var 6>> TERMS AND CONDITIONS FOR USE,
        REPRODUCTION, AND DISTRIBUTION"""),
    "mpl-header": ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at"""),
} | {f"{label}-header": (label, f"""is free software<<optional>>;<<end>> you can redistribute it and/or modify it under the terms of the GNU
        {name}General Public License as published by the Free Software Foundation<<optional>>; either<<end>> version <<var 2>>
        <<optional>>of the License<<end>><<optional>>, or (at your option) any later version<<end>>. <<var 6>> is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details.""")
     for label, name in (("gpl", ""), ("lgpl", "Lesser "), ("agpl", "Affero "))
} | {f"{label}-title": (label, f"""GNU {name}GENERAL PUBLIC LICENSE Version <<var 6>> Copyright (C) <<var 30>> Everyone is permitted to copy
        and distribute verbatim copies of this license document, but changing it is not allowed.""")
     for label, name in (("gpl", ""), ("lgpl", "LESSER "), ("agpl", "AFFERO "))
} | {f"spdx-{name.lower()}": (label, f"SPDX-License-Identifier: {name}")
     for name, label in (("MIT", "mit"), ("ISC", "isc"), ("BSD-2-Clause", "bsd"), ("BSD-3-Clause", "bsd"), ("Zlib", "zlib"), ("Unlicense", "unlicense"),
                         ("Apache-2.0", "apache"), ("MPL-2.0", "mpl"), ("GPL-2.0", "gpl"), ("GPL-3.0", "gpl"), ("LGPL-2.1", "lgpl"),
                         ("LGPL-3.0", "lgpl"), ("AGPL-3.0", "agpl"))
} | {
    "apache-notice": ("apache", """Licensed under the Apache License, Version 2.0<<optional>> (the "License"); you may
        not use this file except in compliance with the License.<<end>>"""),
    "mit-notice": ("mit", "<<optional>>This <<var 3>> is <<end>>Released under the <<optional>>terms of the <<end>>MIT License"),
    "gpl-notice": ("gpl", """This <<var 3>> is <<optional>>free software and is <<end>>licensed under the GNU
        <<optional>>Lesser <<end>><<optional>>Affero <<end>>General Public License<<optional>>, version <<var 2>><<end>>"""),
    "cc-notice": ("cc", """Licensed under <<optional>>a <<end>><<optional>>the <<end>>
        CC BY<<optional>>-NC<<end>><<optional>>-SA<<end>><<optional>>-ND<<end>><<optional>> 4.0<<end>>"""),
    "cc-long-notice": ("cc", """licensed under <<optional>>a <<end>><<optional>>the <<end>>Creative Commons
        Attribution<<optional>> NonCommercial<<end>><<optional>> ShareAlike<<end>><<optional>> NoDerivatives<<end>>
        <<optional>>4.0 <<end>><<optional>>International <<end>><<optional>>License<<end>>"""),
}


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """A template as states 0..n; state i reads its word, may skip to others without reading, or loops in a var."""

    def __init__(self, template: str):
        steps: list[tuple[bytes | None, int]] = []   # (word or None for a var word, state after it)
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        for part in re.findall(r"<<[^>]*>>|[^<]+|<", template):
            mark = part[2:-2].split() if part.startswith("<<") else []
            if mark[:1] == ["optional"]:
                opened.append(len(steps))
            elif mark[:1] == ["end"]:
                self.skips.setdefault(opened.pop(), []).append(len(steps))
            elif mark[:1] == ["var"]:
                n, start = int(mark[1]), len(steps)
                for i in range(n):
                    self.skips.setdefault(start + i, []).append(start + n)
                steps += [(None, start + i + 1) for i in range(n)]
            else:
                steps += [(w, len(steps) + i + 1) for i, w in enumerate(words_of(part.encode()))]
        if opened:
            raise ValueError("an optional region is not closed")
        self.words = [w for w, _ in steps]
        self.end = len(steps)
        self.start = self.closed({0})
        if self.end in self.start or any(self.words[s] is None for s in self.start):
            raise ValueError("a template must begin with a word and hold mandatory wording")
        self.first = {self.words[s] for s in self.start}
        # words that no accepted text lacks: without one of them nothing is run
        self.needed = set(self.words) - {None}
        for a, ends in self.skips.items():
            self.needed -= set(self.words[a:max(ends)]) - set(self.words[:a]) - set(self.words[max(ends):])
        for a, ends in self.skips.items():
            outside = [w for i, w in enumerate(self.words) if not any(x <= i < max(e) for x, e in self.skips.items())]
            self.needed &= set(outside)

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[bytes], start: int) -> int | None:
        """Where the longest accepted run of words from start ends; None when there is none."""
        states, i, best = self.start, start, None
        while states:
            if self.end in states:
                best = i
            if i == len(words):
                break
            w = words[i]
            states = self.closed({s + 1 for s in states if s < self.end and (self.words[s] is None or self.words[s] == w)})
            i += 1
        return best


def compiled(templates: dict = TEMPLATES) -> list[tuple[str, str, Automaton]]:
    return [(name, label, Automaton(text)) for name, (label, text) in templates.items()]


def _phrases(words: list[bytes], places: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    n = len(phrase)
    return [i for i in places.get(phrase[0], ()) if words[i:i + n] == phrase]


def scan(text: bytes, automata: list) -> tuple:
    """One value for each of FIELDS."""
    words = words_of(text)
    wanted = {p.split()[0].encode() for p in BASE}.union(*(a.first for _, _, a in automata))
    present = set(words)
    places: dict[bytes, list[int]] = {}
    if not wanted.isdisjoint(present):
        for i, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(i)
    base = {p: _phrases(words, places, p.encode().split()) for p in BASE} if places else {}
    starts = sorted(i for found in base.values() for i in found)
    base_labels = {BASE[p] for p, found in base.items() if found}
    matches = []
    for name, label, auto in automata if places else ():
        if not auto.needed <= present:
            continue
        free = 0
        for i in sorted(i for w in auto.first for i in places.get(w, ())):
            if i < free:
                continue
            stop = auto.match(words, i)
            if stop is not None:
                matches.append({"template": name, "label": label, "start": i, "stop": stop})
                free = stop
    labels = base_labels | {m["label"] for m in matches}
    # a whole template is certain; a phrase alone may only mention a license
    score = 1.0 if matches else 0.5 if starts else 0.0
    return (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None,
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, matches)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict = TEMPLATES) -> DataFrame:
    """(id, FIELDS) of every row: base phrases, and all labels with the accepted templates and their word ranges.

    Matches of a template do not overlap. The score is 1 with an accepted template, 0.5 with base phrases only, else 0.
    A null or empty text has no words, no labels and null places. Repeated rows stay repeated, null ids have rows too, an
    empty table gives an empty table, further columns are not read.
    """
    def measure(texts):
        import pyarrow as pa

        automata = once(f"licenses {hash(tuple(sorted(templates.items())))}", lambda: compiled(templates))
        columns = [list(c) for c in zip(*(scan(t, automata) for t in texts))] or [[] for _ in range(8)]
        kinds = pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kinds]
        return [pa.array(c, t) for c, t in zip(columns, types)]

    return map_texts(docs, id_col, text_col, measure, FIELDS)
