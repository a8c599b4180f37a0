"""Licence scans with a generalised suffix automaton of template words.

The automaton accepts every run of words of every template. A text is streamed
through it, which gives at each word the longest run that ends there and stands in
a template. Long runs are chained, forward in text and template alike, into spans;
a template whose words are covered for the most part gives its label. Beside this,
the base phrases are found wherever their words stand consecutively.

Words are runs of ASCII letters and digits and of characters above U+007F, after
lower-casing A-Z. Null and empty texts have none. Repeated rows are scanned each.
"""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontime.llm.common import body

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Labels and the usual wordings of notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]

LEAST_MATCH = 3  #: words of a run that is chained
MOST_GAP = 8  #: words between chained runs, in the text and in the template
COVERED = 0.8  #: share of a template's words that gives its label

_BREAKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The words, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_BREAKS).split()


class SuffixAutomaton:
    """The runs of several sequences of word numbers; each state knows where it ends in the sequences that have it."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # sequence -> end of the first occurrence
        self.places: list[dict[int, list[int]]] = [{}]  # sequence -> ends of all occurrences
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for number, sequence in enumerate(sequences):
            state = 0
            for end, word in enumerate(sequence, 1):
                state = self.next[state][word]
                up = state
                while up > 0:
                    self.ends[up].setdefault(number, end)
                    self.places[up].setdefault(number, []).append(end)
                    up = self.link[up]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        self.places.append({})
        return len(self.next) - 1

    def _split(self, at: int, word: int, old: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = clone
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another sequence has it already
            old = self.next[last][word]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, word, old)
        return new

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the runs that can't go on, by matching statistics."""
        state, length = 0, 0
        for at, word in enumerate(words):
            if word not in self.next[state]:
                if length:
                    yield at, length, state
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if word not in self.next[state]:
                    continue
            state, length = self.next[state][word], length + 1
        if length:
            yield len(words), length, state


class Scanner:
    """Templates compiled once a worker."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.number: dict[bytes, int] = {}
        number = lambda text: [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
        self.labels = [label for label, _ in templates]
        sequences = [number(text) for _, text in templates]
        self.sizes = [len(s) for s in sequences]
        self.phrases = [(number(p), label) for p, label in phrases.items()]
        self.automaton = SuffixAutomaton(sequences)

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score, spans (label, first word, end)."""
        words = words_of(text)
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        n_base, first, last, base = 0, None, None, set()
        known = ids >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= 2].tolist()
        if runs:
            for phrase, label in self.phrases:
                n = len(ids) - len(phrase) + 1
                if n > 0:
                    at = np.flatnonzero(np.logical_and.reduce([ids[k : k + n] == w for k, w in enumerate(phrase)]))
                    if len(at):
                        n_base += len(at)
                        base.add(label)
                        first = int(at[0]) if first is None else min(first, int(at[0]))
                        last = int(at[-1]) if last is None else max(last, int(at[-1]))
        score, spans = self._chain(ids, runs)
        labels = base | {label for label, _, _ in spans}
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans

    def _chain(self, ids: np.ndarray, runs: list[list[int]]) -> tuple[float, list[tuple[str, int, int]]]:
        """The best share of a template that a chain covers, and the chains that cover enough."""
        automaton, found = self.automaton, {}
        for start, stop in runs:
            if stop - start >= LEAST_MATCH:
                for end, length, state in automaton.matches(ids[start:stop].tolist()):
                    if length >= LEAST_MATCH:
                        for template, places in automaton.places[state].items():
                            found.setdefault(template, []).extend((start + end, at, length) for at in places)
        score, spans = 0.0, []
        for template, matches in sorted(found.items()):
            chains: list[list[int]] = []  # text start, text end, template end, words covered
            for end, at, length in sorted(matches):
                best = None
                for chain in reversed(chains):
                    if end - length - chain[1] > MOST_GAP:  # chains are in the order of their ends
                        break
                    overlap = max(0, chain[1] - (end - length), chain[2] - (at - length))
                    if overlap < length and 0 <= at - length + overlap - chain[2] <= MOST_GAP:
                        grown = [chain[0], end, at, chain[3] + length - overlap]
                        best = grown if best is None or grown[3] > best[3] else best
                chains.append(best or [end - length, end, at, length])
            for chain in chains:
                share = chain[3] / self.sizes[template]
                score = max(score, share)
                if share >= COVERED:
                    spans.append((self.labels[template], chain[0], chain[1]))
        return min(score, 1.0), sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))


_scanner: list[Scanner] = []


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each document."""

    @F.pandas_udf(
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label string, first long, end long>>"
    )
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not _scanner:
            _scanner.append(Scanner())
        for texts in batches:
            rows = [_scanner[0].scan(t) for t in texts]
            made = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            made[["first_word", "last_word"]] = made[["first_word", "last_word"]].astype("Int64")
            made["spans"] = [[{"label": a, "first": b, "end": c} for a, b, c in s] for s in made["spans"]]
            yield made

    return docs.select("doc_id", run(body()).alias("s")).select("doc_id", "s.*")


def op10_licence_scan(docs: DataFrame) -> DataFrame:
    """What was found in each document."""
    return scan(docs).drop("spans")
