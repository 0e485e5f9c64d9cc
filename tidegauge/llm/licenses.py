"""Licence detection with a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template (and of the short base phrases) as a path. A document is
streamed through it once: after each word the state and match length are the matching statistics, the longest run
ending there that some template contains; suffix links give the shorter runs of other templates. A run counts for a
template where that template cannot go on, and runs that are long enough are chained per template, in document and
template order, into covered spans; the covered share of a template is its score. The automaton
depends on the templates alone, so what tasks hold is bounded by them and not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import ascii_words, bound_batches

#: Phrases and their labels: fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings, notices and whole short licences with their labels: fixed values, public texts.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)


class SuffixAutomaton:
    """All runs of words of several word sequences, with the places where each state's runs end."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(texts):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word, ends)
                ends[last].add((number, at))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]
        self.words = frozenset(w for t in texts for w in t)

    def _new(self, length: int, ends: list[set], follow: dict, link: int) -> int:
        self.next.append(dict(follow))
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, state: int, word: bytes, to: int, ends: list[set]) -> int:
        """The state for the shorter runs of ``to`` that end behind ``state``."""
        if self.length[to] == self.length[state] + 1:
            return to
        clone = self._new(self.length[state] + 1, ends, self.next[to], self.link[to])
        self.link[to] = clone
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes, ends: list[set]) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word], ends)
        made = self._new(self.length[last] + 1, ends, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, word, self.next[state][word], ends)
        return made

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest run ending there) at every word where it is not 0."""
        following, link, length, known = self.next, self.link, self.length, self.words
        state = size = 0
        before = -2
        for at, word in enumerate(words):
            if word not in known:
                continue
            if at != before + 1:
                state = size = 0
            before = at
            while state and word not in following[state]:
                state = link[state]
                size = length[state]
            state = following[state].get(word, 0)
            size = size + 1 if state else 0
            if state:
                yield at, state, size


class Scanner:
    """Base phrases and template coverage of one document at a time."""

    def __init__(self, phrases: dict[str, str], templates: tuple[tuple[str, str], ...], least: int, share: float):
        self.phrases = [(ascii_words(p.encode()), label) for p, label in phrases.items()]
        self.templates = [(ascii_words(t.encode()), label) for label, t in templates if ascii_words(t.encode())]
        self.automaton = SuffixAutomaton([w for w, _ in self.phrases] + [w for w, _ in self.templates])
        self.least, self.share = least, share
        n = len(self.phrases)
        # state -> phrases that end there; a phrase's runs all end at its own last word
        self.closing = [[k for k, at in e if k < n and at == len(self.phrases[k][0]) - 1] for e in self.automaton.ends]
        self.places = [[(k - n, at) for k, at in e if k >= n] for e in self.automaton.ends]
        # no run shorter than the shortest phrase or template matters
        self.shortest = min([len(p) for p, _ in self.phrases + self.templates] + [least])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float], list[tuple[int, int, str]]]:
        """Phrase places (start, label); coverage by template label; covered spans (first word, end, label)."""
        stats = [s for s in self.automaton.statistics(words) if s[2] >= 2 or self.shortest < 2]
        base = []
        for at, state, size in stats:
            while state > 0:
                for k in self.closing[state]:
                    n = len(self.phrases[k][0])
                    if self.automaton.length[self.automaton.link[state]] < n <= min(size, self.automaton.length[state]):
                        base.append((at - n + 1, self.phrases[k][1]))
                state = self.automaton.link[state]
        runs = self.runs(words, stats)
        score, spans = {}, []
        for k, found in runs.items():
            words_, label = self.templates[k]
            covered, chain = self._chain(found, 2 * len(words_))
            if covered / len(words_) > score.get(label, 0.0):
                score[label] = covered / len(words_)
            if covered / len(words_) >= self.share:
                spans += [(a, a + n, label) for a, _, n in chain]
        return base, score, sorted(spans)

    def runs(self, words: list[bytes], stats: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """Template -> (first word, first template word, length) of the runs that neither side continues."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        link, length = self.automaton.link, self.automaton.length
        fewest = min([self.least, *(len(t) for t, _ in self.templates)])
        for at, state, size in stats:
            follower = words[at + 1] if at + 1 < len(words) else None
            met: set[tuple[int, int]] = set()
            while state > 0 and size >= fewest:
                # longer runs come first, so a place of a template counts with its longest
                for k, end in self.places[state]:
                    template = self.templates[k][0]
                    if (k, end) not in met:
                        met.add((k, end))
                        goes_on = end + 1 < len(template) and template[end + 1] == follower
                        if not goes_on and size >= min(self.least, len(template)):
                            found.setdefault(k, []).append((at - size + 1, end - size + 1, size))
                state = link[state]
                size = length[state]
        return found

    @staticmethod
    def _chain(runs: list[tuple[int, int, int]], reach: int) -> tuple[int, list[tuple[int, int, int]]]:
        """The heaviest chain of runs that rises in document and template; neighbours at most ``reach`` words apart."""
        runs = sorted(set(runs))
        best: list[tuple[int, int]] = []
        for i, (a, t, n) in enumerate(runs):
            top = (n, -1)
            for j in range(i - 1, -1, -1):
                b, u, m = runs[j]
                if a - b > 2 * reach:
                    break
                if b + m <= a and u + m <= t and a - (b + m) <= reach and best[j][0] + n > top[0]:
                    top = (best[j][0] + n, j)
            best.append(top)
        at = max(range(len(runs)), key=lambda i: (best[i][0], -i))
        covered, chain = best[at][0], []
        while at >= 0:
            chain.append(runs[at])
            at = best[at][1]
        return covered, chain[::-1]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:int,end:int,label:string>>"
_SCANNERS: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] | None = None, least: int = 4, share: float = 0.6) -> DataFrame:
    """Per row: doc_id, word and phrase counts, first and last phrase place, labels, score and covered spans.

    A label is given for a base phrase, or for a template of which a chain of runs of at least ``least`` words covers
    at least ``share``; ``spans`` are the words of such chains. ``score`` is the largest covered share of any template, and 1 where a base phrase stands.
    Null or wordless text: no words, no labels (''), null places, score 0. Repeated rows are scanned one by one;
    other columns are dropped.
    """
    bound_batches(docs.sparkSession)
    setting = (tuple((phrases or PHRASES).items()), tuple(templates or TEMPLATES), least, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setting not in _SCANNERS:
            _SCANNERS[setting] = Scanner(dict(setting[0]), setting[1], least, share)
        scanner = _SCANNERS[setting]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in kinds]
                for text in part.column(1).to_pylist():
                    words = ascii_words(text)
                    base, score, spans = scanner.scan(words)
                    base_labels = sorted({label for _, label in base})
                    labels = sorted({*base_labels, *(label for label, s in score.items() if s >= share)})
                    starts = [a for a, _ in base]
                    top = 1.0 if base else max(score.values(), default=0.0)
                    row = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), top)
                    for values, value in zip(out, (*row, [{"first": a, "end": b, "label": c} for a, b, c in spans]), strict=True):
                        values.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
