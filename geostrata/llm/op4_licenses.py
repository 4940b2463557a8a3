"""License scans with a generalised suffix automaton (operator 4).

The automaton of all template word sequences is built once for each Python worker.
Documents stream through it in one pass over the scan: at each word it gives the longest
run ending there that occurs in some template (matching statistics). Runs of at least
``MIN_RUN`` words that can't be extended are placed wherever their words stand in a
template, and chained, in order in both document and template, into covered template
spans; a template whose covered share reaches ``COVERED`` gives its label. Words that no
template has reset the automaton, so only stretches of template words are walked.

Templates are a parameter of ``scan`` (``read_templates`` takes a folder of licence
texts); the default ones are notices and short licences.

Independent of that, every place of a base phrase counts. Defined results: null text is
empty: no words, no labels, score 0; overlapping places all count; of equal covers the
one that ends first in the document is given; repeated rows each get a row; without
templates only base labels are given; further columns are ignored.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import column_or_null, slices, small_batches, table

#: Base phrases and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Templates: licence notices as their publishers word them (fixed values); long ones stand whole and by their grant.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License "
     "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
     "either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
     "See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
     "either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
     "either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
     "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
     "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)
MIN_RUN = 4
COVERED = 0.75

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")


def split_words(text: str) -> list[bytes]:
    return [w for w in words_of(text) if w]


@dataclass
class _State:
    length: int = 0
    link: int = -1
    step: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # template and end of the prefixes that are this state's longest words


class SuffixAutomaton:
    """Of several word sequences; a state's words end where its own prefixes and those of the states that link to it end."""

    def __init__(self, sequences: list[list[int]]):
        self.states = [_State()]
        for t, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._append(last, word)
                self.states[last].ends.append((t, end))
        self.linked: list[list[int]] = [[] for _ in self.states]
        for k, state in enumerate(self.states[1:], 1):
            self.linked[state.link].append(k)
        self.places = lru_cache(maxsize=100_000)(self._places)

    def _places(self, state: int) -> list[tuple[int, int]]:
        """Template and end of every place of the state's words."""
        found, open_ = [], [state]
        while open_:
            k = open_.pop()
            found += self.states[k].ends
            open_ += self.linked[k]
        return sorted(found)

    def _append(self, last: int, word: int) -> int:
        states = self.states
        if word in states[last].step:
            q = states[last].step[word]
            if states[q].length == states[last].length + 1:
                return q
            return self._clone(last, q, word)
        states.append(_State(states[last].length + 1))
        new, p = len(states) - 1, last
        while p >= 0 and word not in states[p].step:
            states[p].step[word] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        else:
            q = states[p].step[word]
            states[new].link = q if states[q].length == states[p].length + 1 else self._clone(p, q, word)
        return new

    def _clone(self, p: int, q: int, word: int) -> int:
        states = self.states
        states.append(_State(states[p].length + 1, states[q].link, dict(states[q].step)))
        copy = len(states) - 1
        states[q].link = copy
        while p >= 0 and states[p].step.get(word) == q:
            states[p].step[word] = copy
            p = states[p].link
        return copy

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest run ending at each word that occurs in some sequence."""
        states, at, length = self.states, 0, 0
        for w in words:
            while at and w not in states[at].step:
                at = states[at].link
                length = states[at].length
            if w in states[at].step:
                at, length = states[at].step[w], length + 1
            yield at, length


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE, min_run: int = MIN_RUN, covered: float = COVERED):
        self.labels = [label for label, _ in templates]
        sequences = [split_words(text) for _, text in templates]
        phrases = [(split_words(phrase), label) for phrase, label in base]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for s in [*sequences, *(p for p, _ in phrases)] for w in s), 1)}
        self.lengths = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in s] for s in sequences])
        self.phrases = [(np.array([self.ids[w] for w in p]), label) for p, label in phrases]
        self.min_run, self.covered = min_run, covered

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``first word, words, state`` of each run that can't be extended to the right."""
        known = np.concatenate(([False], ids > 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if z - a < self.min_run:
                continue
            before = (0, 0)
            for i, (state, length) in enumerate(self.automaton.statistics(ids[a:z].tolist()), a):
                if length <= before[1] and before[1] >= self.min_run:
                    yield i - before[1], before[1], before[0]
                before = (state, length)
            if before[1] >= self.min_run:
                yield z - before[1], before[1], before[0]

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """Best chain of each template: ``template, first word, last word, covered words, share``."""
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for start, n, state in self.matches(ids):
            for t, end in self.automaton.places(state):
                by_template[t].append((start, end - n, n))
        found = []
        for t, runs in sorted(by_template.items()):
            size, best = self.lengths[t], None
            chains: list[tuple[int, int, int, int]] = []  # covered, first word, document end, template end
            for start, at, n in runs:
                grown = (n, start, start + n, at + n)
                for covered, first, doc_end, end in reversed(chains):
                    if doc_end < start - 2 * size:  # ends don't fall, so all earlier ones are too far as well
                        break
                    if doc_end <= start and end <= at and start - first <= 2 * size and covered + n > grown[0]:
                        grown = (covered + n, first, start + n, at + n)
                chains.append(grown)
                if best is None or grown[0] > best[0]:
                    best = grown
            found.append((t, best[1], best[2] - 1, best[0], best[0] / size))
        return found

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
        blank = np.fromiter(map(len, words), np.int32, len(words)) == 0
        ids = ids[~blank]
        places, base = [], set()
        for phrase, label in self.phrases:
            last = len(ids) - len(phrase) + 1
            if last > 0:
                hit = np.flatnonzero(ids[len(phrase) - 1 :] == phrase[-1])
                for k in range(len(phrase) - 1):
                    hit = hit[ids[hit + k] == phrase[k]]
                if len(hit):
                    base.add(label)
                    places.append(hit)
        at = np.concatenate(places) if places else np.zeros(0, int)
        spans = self.spans(ids)
        labels = base | {self.labels[t] for t, *_, share in spans if share >= self.covered}
        score = max((share for *_, share in spans), default=0.0)
        return len(ids), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None, ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score), spans


@lru_cache(maxsize=4)
def _scanner(templates, base, min_run: int, covered: float) -> Scanner:
    return Scanner(templates, base, min_run, covered)


def read_templates(spark, path: str) -> tuple[tuple[str, str], ...]:
    """Label (the file's name without its ending) and text of every file of a folder of licence texts."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").orderBy("name").collect()
    return tuple((os.path.splitext(r["name"])[0], r["value"]) for r in rows)


_SPANS = pa.list_(pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, min_run: int = MIN_RUN, covered: float = COVERED) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for every row of ``docs(doc_id, text)``.

    ``templates`` and ``base`` are tuples of (label, text) and (phrase, label); spans name templates by their place.
    """
    templates, base = tuple(map(tuple, templates)), tuple(map(tuple, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, base, min_run, covered)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), _SPANS]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in slices([t or "" for t in texts], 8_000_000):
                got = [scanner.scan(t or "") for t in texts[a:z]]
                spans = [[dict(zip(("template", "first_word", "last_word", "covered", "share"), s, strict=True)) for s in g[-1]] for g in got]
                columns = [pa.array(c, k) for c, k in zip([*list(zip(*got, strict=True))[:-1], spans], kinds, strict=True)]
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), *columns], ["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template int, first_word long, last_word long, covered long, share double>>"
    return small_batches(docs.select(column_or_null(docs, "doc_id", "long"), column_or_null(docs, "text", "string"))).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
