"""Licence scan by a positional rare-token index.

Words are weighed by inverse document frequency, taken over the whole table.  The index
holds, of each licence text, the ``RAREST`` words of highest weight with all their
positions, so every licence has its own, however many stand in a file.  Each of these words in a file
is looked up, and each posting (template, position) is shifted by its place in the file to the start
that a copy would have there.  The starts of a template are intersected: where several
of its rare words agree on a start, but for a slack in which words may have been put in or left out, there
is a candidate.  It is verified: the template's mandatory key phrases must stand, word for word, where the
start puts them, within the slack, and the words of the template that are there must have
enough of its weight.  Of two matches in one place the one that explains more stays, so a longer
licence is not also taken for a shorter one that it contains.

A base phrase is found by its rarest word and an exact comparison, at every place.

Edge cases: a null text has no words; very long texts are searched whole; empty tables give empty
results; repeated rows give equal rows; ties in frequency go to the word that sorts first; columns other
than id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_bytes, pieces, plain_words, schema_of

#: Phrases that count at every place, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Licence wordings and the key phrases that must be in them.
TEMPLATES = {
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    "mit-opening": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction""",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    "bsd-2-clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce the above copyright notice"],
    ),
    "bsd-3-clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
        holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
        USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ["redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software"],
    ),
    "bsd-opening": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""",
        ["redistribution and use in source and binary forms", "with or without modification are permitted"],
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
        OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ["distribute this software for any purpose with or without fee is hereby granted", "permission notice appear in all copies"],
    ),
    "0bsd": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        ["with or without fee is hereby granted the software is provided as is"],
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to
        use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented;
        you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
        ["the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"],
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
        ["free and unencumbered software released into the public domain"],
    ),
    "bsl-1.0": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license (the "Software") to use, reproduce,
        display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,
        and to permit third-parties to whom the Software is furnished to do so""",
        ["to any person or organization obtaining a copy of the software and accompanying documentation"],
    ),
    "apache-2": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
        ["unless required by applicable law or agreed to in writing", "warranties or conditions of any kind"],
    ),
    "apache-2-basis": (
        """Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND""",
        ["unless required by applicable law or agreed to in writing", "warranties or conditions of any kind"],
    ),
    "gpl-2": (
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version.""",
        ["gnu general public license as published by the free software foundation", "version 2 of the license"],
    ),
    "gpl-3": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
        ["gnu general public license as published by the free software foundation", "version 3 of the license"],
    ),
    "gpl-3-notice": ("licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    "lgpl-2.1": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
        (at your option) any later version.""",
        ["gnu lesser general public license", "version 2 1 of the license"],
    ),
    "agpl-3": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
        ["gnu affero general public license", "version 3 of the license"],
    ),
    "mpl-2": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ["subject to the terms of the mozilla public license v 2 0"],
    ),
    "epl-2": (
        """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License 2.0 which is available at""",
        ["under the terms of the eclipse public license 2 0"],
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ["creative commons attribution sharealike 4 0"],
    ),
}

#: Templates whose label is not their name.
_LABELS = {
    "mit-opening": "mit",
    "bsd-opening": "bsd",
    "apache-2-basis": "apache-2",
    "gpl-3-notice": "gpl-3",
}

#: Words of highest weight that a template is looked up by.
RAREST = 12

#: The share of a template's weight that its words must have where it is found: of its rare words, and of all.
BAR = 0.3

#: One word in so many may have been put in or left out, and two always.
SLACK = 16


@dataclass(frozen=True)
class Template:
    """Words, label, and the key phrases with their offsets."""

    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]

    @property
    def slack(self) -> int:
        return 2 + len(self.words) // SLACK


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(plain_words(text.encode()))


def templates() -> list[Template]:
    """All licence templates."""
    found = []
    for name, (text, keys) in TEMPLATES.items():
        own = _words(text)
        placed = tuple((next(i for i in range(len(own)) if own[i : i + len(k)] == k), k) for k in map(_words, keys))
        found.append(Template(_LABELS.get(name, name), own, placed))
    return found


def frequencies(df: DataFrame, text: str = "text") -> dict[bytes, int]:
    """In how many rows of the whole table each licence word stands; bounded by the templates."""
    vocabulary = {w for t in templates() for w in t.words} | {w for p in BASE_PHRASES for w in _words(p)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        rows = 0
        for piece in pieces(batches, text):
            for content in as_bytes(piece.column(text)):
                seen.update(vocabulary.intersection(plain_words(content)))
                rows += 1
        names, n = [b"", *seen], [rows, *seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    counted = df.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


class Index:
    """Weights of licence words, the postings of every template's rare words, and the base phrases by theirs."""

    def __init__(self, found: list[Template], counts: dict[bytes, int]):
        rows = counts.get(b"", 0)
        weigh = lambda w: math.log((1 + rows) / (1 + counts.get(w, 0))) + 1e-6
        self.templates = found
        self.idf = {w: weigh(w) for t in found for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.bars = []
        for k, t in enumerate(found):
            rare = sorted(set(t.words), key=lambda w: (-self.idf[w], w))[:RAREST]
            for i, w in enumerate(t.words):
                if w in rare:
                    self.postings[w].append((k, i))
            self.bars.append(BAR * sum(self.idf[w] for w in rare))
        self.base: dict[bytes, list[tuple[str, int, tuple[bytes, ...]]]] = defaultdict(list)
        for phrase, label in BASE_PHRASES.items():
            own = _words(phrase)
            at = min(range(len(own)), key=lambda i: (-weigh(own[i]), own[i], i))
            self.base[own[at]].append((label, at, own))
        self.known = self.postings.keys() | self.base.keys()

    def scan(self, words: list[bytes]) -> list[tuple[str, bool, int, int, float]]:
        """``(label, base, start, end, score)`` of all matches, base phrases first, by place."""
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        base = []
        for at, w in enumerate(words):
            if w not in self.known:
                continue
            for label, offset, own in self.base.get(w, ()):
                start = at - offset
                if start >= 0 and tuple(words[start : start + len(own)]) == own:
                    base.append((label, True, start, start + len(own), 1.0))
            for k, offset in self.postings.get(w, ()):
                votes[k].append((at - offset, w))
        found = [m for k, cast in votes.items() for m in self._matches(k, sorted(cast), words)]
        return sorted(base, key=lambda m: (m[2], m[0])) + _best(found)

    def _matches(self, k: int, votes: list[tuple[int, bytes]], words: list[bytes]) -> Iterator[tuple[float, str, int, int, float]]:
        """``(weight, label, start, end, score)`` where the rare words of a template agree."""
        slack, agreeing, weight, end, done = self.templates[k].slack, Counter(), 0.0, 0, None
        for begin, (low, first) in enumerate(votes):
            while end < len(votes) and votes[end][0] <= low + slack:
                agreeing[votes[end][1]] += 1
                weight += self.idf[votes[end][1]] * (agreeing[votes[end][1]] == 1)
                end += 1
            if weight >= self.bars[k] - 1e-9 and (done is None or low > done):
                starts = Counter()
                for start, w in votes[begin:end]:
                    starts[start] += self.idf[w]
                start = min(starts, key=lambda s: (-starts[s], s))
                if match := self._verified(k, start, words):
                    yield match
                    done = start + slack
            agreeing[first] -= 1
            weight -= self.idf[first] * (agreeing[first] == 0)

    def _verified(self, k: int, start: int, words: list[bytes]) -> tuple[float, str, int, int, float] | None:
        t = self.templates[k]
        for offset, key in t.keys:
            places = range(max(0, start + offset - t.slack), start + offset + t.slack + 1)
            if not any(tuple(words[p : p + len(key)]) == key for p in places):
                return None
        low, high = max(0, start), min(len(words), start + len(t.words))
        there = Counter(words[max(0, low - t.slack) : high + t.slack]) & Counter(t.words)
        weight = sum(self.idf[w] * n for w, n in there.items())
        score = weight / sum(self.idf[w] for w in t.words)
        return (weight, t.label, low, high, min(1.0, score)) if score >= BAR else None


def _best(found: list[tuple[float, str, int, int, float]]) -> list[tuple[str, bool, int, int, float]]:
    """Matches by place, without those that lie at least half in a match that explains more.

    Kept matches are found by their starts, so a match is compared with those around it alone.
    """
    kept: list[tuple[float, str, int, int, float]] = []
    starts: list[int] = []
    by_start: list[tuple[int, int]] = []
    longest = max((m[3] - m[2] for m in found), default=0)
    for m in sorted(found, key=lambda m: (-m[0] * m[4], m[2], m[1])):
        near = range(bisect_right(starts, m[2] - longest), bisect_left(starts, m[3]))
        if not any(2 * (min(m[3], by_start[i][1]) - max(m[2], by_start[i][0])) >= m[3] - m[2] for i in near):
            kept.append(m)
            at = bisect_right(starts, m[2])
            starts.insert(at, m[2])
            by_start.insert(at, (m[2], m[3]))
    return [(label, False, a, b, score) for _, label, a, b, score in sorted(kept, key=lambda m: (m[2], m[3], m[1]))]


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_words, matches)`` of every row; a match has label, base, start, stop (in words) and score."""
    shared = df.sparkSession.sparkContext.broadcast(frequencies(df, text))
    kind = pa.struct(
        [("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates(), shared.value)
        for piece in pieces(batches, text):
            n_words, found = [], []
            for content in as_bytes(piece.column(text)):
                words = plain_words(content)
                n_words.append(len(words))
                own = index.scan(words)
                found.append([dict(zip(("label", "base", "start", "stop", "score"), m)) for m in own])
            yield pa.RecordBatch.from_arrays(
                [piece.column(id_col), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(kind))],
                names=[id_col, "n_words", "matches"],
            )

    ddl = "n_words long, matches array<struct<label:string,base:boolean,start:long,stop:long,score:double>>"
    return df.select(id_col, text).mapInArrow(run, schema_of(df, [id_col], ddl))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last place and labels of base phrases; labels and score of all matches."""
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda m: F.array_join(F.array_sort(F.array_distinct(m["label"])), ",")
    return found.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.col("matches")["score"]), F.lit(0.0)).alias("score"),
    )
