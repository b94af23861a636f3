"""License scans with a positional index of rare words.

The index lists, for every rare word of the licence templates, the templates and positions where it stands. What
is rare is counted: documents that hold each licence word, over the whole corpus, give its inverse document
frequency, and the half of a template's positions whose words are rarest are its anchors. In a file only these
words are looked up; each posting votes for the place at which its template would have to start. Votes within
``SLACK`` words are taken together, as names and years shift what follows them. Where enough different anchors
of a template meet, the file's words there must also hold all mandatory key phrases of the template, and none
of those that mark another licence. Phrases that name a licence outright are found everywhere as well.

Defined results: null or empty text has no word, no label and score 0; a file with several licences has all
their labels; a template that stands more than once counts once; repeated rows give repeated results and count
in the frequencies; without documents all words are equally rare; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import ALNUM, keyed, slices, utf8

#: Phrases that give a label wherever they stand.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Template(NamedTuple):
    label: str
    text: str
    required: tuple[str, ...]
    absent: tuple[str, ...] = ()


_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
_GNU = """This {0} is free software; you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software
Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the {1} for more details."""

#: Licence texts, and the notices that long licences ask for, with the phrases that must stand in
#: them and those that must not.
TEMPLATES = [
    Template("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("permission is hereby granted free of charge", "the above copyright notice and this permission notice")),
    Template("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit-notice", "released under the MIT License", ("the mit license",)),
    Template("bsd-2-clause", _BSD + _WARRANTY, ("redistributions in binary form must reproduce",), ("neither the name",)),
    Template("bsd-3-clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _WARRANTY, ("redistributions in binary form must reproduce", "neither the name")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", ("with or without fee is hereby granted", "provided that the above copyright notice")),
    Template("0bsd", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS.""", ("with or without fee is hereby granted",), ("provided that the above copyright notice",)),
    Template("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution.""", ("altered source versions must be plainly marked",)),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""", ("unencumbered software", "public domain")),
    Template("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""", ("any person or organization", "derivative works of the software")),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache license version 2 0", "unless required by applicable law")),
    Template("apache-2.0-notice", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", _GNU.format("program", "GNU General Public License", "2"), ("gnu general public license", "version 2 of the license")),
    Template("gpl-3.0", _GNU.format("program", "GNU General Public License", "3"), ("gnu general public license", "version 3 of the license")),
    Template("gpl-3.0-notice", "licensed under the GNU General Public License version 3", ("gnu general public license version 3",)),
    Template("lgpl-2.1", _GNU.format("library", "GNU Lesser General Public License", "2.1"), ("gnu lesser general public license", "version 2 1 of the license")),
    Template("lgpl-3.0", _GNU.format("library", "GNU Lesser General Public License", "3"), ("gnu lesser general public license", "version 3 of the license")),
    Template("agpl-3.0", _GNU.format("program", "GNU Affero General Public License", "3"), ("gnu affero general public license", "version 3 of the license")),
    Template("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license v 2 0",)),
    Template("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc-nd", "licensed under CC BY-NC-ND 4.0", ("cc by nc nd",)),
    Template("cc-by-long", "This work is licensed under a Creative Commons Attribution license", ("creative commons attribution",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
]
#: A template's anchors that must stand in place for a candidate.
SHARE = 0.6
#: Words by which anchors may be shifted against each other.
SLACK = 16


def _words(text: str) -> list[bytes]:
    return text.encode().translate(ALNUM).split()


class Index:
    """Postings of the templates' anchors; words of templates and phrases by number, from 1."""

    def __init__(self, templates: list[Template], phrases: dict[str, str], share: float = SHARE, slack: int = SLACK):
        self.templates, self.share, self.slack = templates, share, slack
        self.vocab: dict[bytes, int] = {}
        number = lambda text: np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in _words(text)])
        self.words = [number(t.text) for t in templates]
        self.required = [[number(p) for p in t.required] for t in templates]
        self.absent = [[number(p) for p in t.absent] for t in templates]
        self.phrases = [(number(p), label) for p, label in phrases.items()]
        self.weigh(np.zeros(len(self.vocab) + 1), 0)

    def weigh(self, documents: np.ndarray, total: int) -> None:
        """Choose anchors by the number of documents that hold each word."""
        idf = np.log((total + 1) / (documents + 1))
        first, template, place = [], [], []
        self.needed, self.anchors = [], []
        for k, t in enumerate(self.words):
            # The rarest half, the earlier ones of equally rare words.
            at = np.sort(np.lexsort((np.arange(len(t)), -idf[t]))[: -(-len(t) // 2)])
            self.anchors.append(len(at))
            self.needed.append(max(1, math.ceil(self.share * len(at))))
            first += t[at].tolist()
            template += [k] * len(at)
            place += at.tolist()
        order = np.argsort(first, kind="stable")
        self.template, self.place = np.array(template)[order], np.array(place)[order]
        self.start = np.searchsorted(np.array(first)[order], np.arange(len(self.vocab) + 2))

    def scan(self, ids: np.ndarray) -> tuple[set[str], float]:
        """Labels of the templates found in a file, and the largest share of a template's anchors in place."""
        size = self.start[ids + 1] - self.start[ids]
        size[ids == 0] = 0
        at = np.flatnonzero(size)
        if not len(at):
            return set(), 0.0
        n = size[at]
        posting = np.repeat(self.start[ids[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        template, place = self.template[posting], self.place[posting]
        begin = np.repeat(at, n) - place
        order = np.lexsort((begin, template))
        template, place, begin = template[order], place[order], begin[order]
        labels, score = set(), 0.0
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(template)) + 1, [len(template)]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = int(template[a])
            if b - a < self.needed[k]:
                continue
            s, p = begin[a:b], place[a:b]
            last = np.searchsorted(s, s + self.slack, side="right")
            for i in np.flatnonzero(last - np.arange(len(s)) >= self.needed[k]).tolist():
                held = len(set(p[i : last[i]].tolist()))
                if held >= self.needed[k] and self._verified(ids, k, int(s[i])):
                    labels.add(self.templates[k].label)
                    score = max(score, held / self.anchors[k])
                    if held == self.anchors[k]:
                        break
        return labels, score

    def _verified(self, ids: np.ndarray, k: int, start: int) -> bool:
        here = ids[max(0, start - self.slack) : max(0, start + len(self.words[k]) + 2 * self.slack)]
        return all(len(places(here, p)) for p in self.required[k]) and not any(len(places(here, p)) for p in self.absent[k])


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after the other."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    on = np.flatnonzero(ids[:n] == phrase[0])
    for k in range(1, len(phrase)):
        on = on[ids[on + k] == phrase[k]]
    return on


def document_counts(docs: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """Documents that hold each word of the index, and how many documents there are; bounded by the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = index.vocab.get, np.zeros(len(index.vocab) + 1, dtype=np.int64)
        for batch in slices(batches):
            for text in utf8(batch.column("text")):
                total[[0, *{get(w, 0) for w in text.translate(ALNUM).split()} - {0}]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    found = keyed(docs).select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(index.vocab) + 1)
    counts[found.column("word").to_numpy()] = found.column("n").to_numpy()
    total, counts[0] = int(counts[0]), 0
    return counts, total


_COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def corpus_index(docs: DataFrame, templates: list[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Index:
    """The index with anchors that are rare in these documents."""
    index = Index(templates, phrases)
    index.weigh(*document_counts(docs, index))
    return index


def scan_licenses(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """A row for each document: words, places of the phrases, the first and last of them, and the labels."""
    index = index or corpus_index(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocab.get
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for text in utf8(batch.column("text")):
                words = text.translate(ALNUM).split()
                ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
                found = [(places(ids, p), label) for p, label in index.phrases]
                base = {label for at, label in found if len(at)}
                at = np.concatenate([a for a, _ in found])
                more, score = index.scan(ids)
                values = (len(words), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, ",".join(sorted(base)), ",".join(sorted(base | more)), score)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], [c.split()[0] for c in _COLUMNS.split(", ")])

    return keyed(docs).select("doc_id", "text").mapInArrow(run, _COLUMNS)
