"""Licence notices in texts: matching statistics over a suffix automaton of licence words, chained into covered spans.

A generalised suffix automaton holds the words of all templates and of the fixed phrases. Every text is streamed through it word by
word: after each word the automaton knows the longest stretch ending there that some template holds. Three things follow.
`places`: wherever a whole fixed phrase ends (its state is the current one or on its suffix links) there is a place of it.
Stretches of LONG words or a whole template that the next word does not extend are long matches. Matches that follow each other
in text and template, with at most GAP words of the text between them, are chained per template; `spans` are the chains that
cover at least SHARE of their template's words.

A text is one stream, in slices of SLICE words that carry the state over, so matches cross slices. Nulls and texts without a
word have no place, no span and score 0. Rows are treated one by one; repeated rows give repeated results and an empty table an
empty one. A kept column with the name of an output (n_words, places, spans, score) gives way to it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from modelwarden.llm.common import over_texts

#: Words of a long match; words of a text that a chain may skip; least share of a template that a span covers.
LONG, GAP, SHARE = 5, 12, 0.8
SLICE = 1 << 16
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording of public licence notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
     "language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software."),
]
#: ASCII letters in lower case, digits and all bytes from 0x80 on stay; any other byte parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split(b" ")


class Automaton:
    """Suffix automaton of several sequences of words; state 0 is the empty string."""

    def __init__(self, sequences: list[list[bytes]]):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sequences = sequences
        self.ends: list[list[tuple[int, int]]] = [[]]
        wholes = []
        for number, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((number, place + 1))
            wholes.append(last)
        by_length = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        #: (sequence, its length) of every whole sequence that ends a state's strings.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.step]
        for number, state in enumerate(wholes):
            if state:
                self.whole[state].append((number, len(sequences[number])))
        for state in by_length:
            self.whole[state] += self.whole[self.link[state]]
        for state in reversed(by_length):
            self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []

    def _new(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state of the longest string of `state` followed by `word`, cut off from longer ones that share it."""
        target = self.step[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def statistics(self, words: Iterable[bytes], state: int = 0, matched: int = 0) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest known stretch that ends with each word, where there is one."""
        step, link, length = self.step, self.link, self.length
        root = step[0]
        for place, word in enumerate(words):
            if word not in root:
                state = matched = 0
                continue
            while word not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state][word]
            matched += 1
            yield place, state, matched


class Scanner:
    """Places of phrases and chained spans of templates in one text at a time."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in templates] + list(phrases.values())
        self.count = len(templates)
        texts = [text for _, text in templates] + list(phrases)
        self.automaton = Automaton([[w for w in words_of(t.encode()) if w] for t in texts])
        self.size = [len(s) for s in self.automaton.sequences]

    def scan(self, words: list[bytes]) -> tuple[list[dict], list[dict], float]:
        """(places, spans, greatest share of a template or phrase covered)."""
        automaton, places = self.automaton, []
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        state = length = 0
        previous = -1
        for start in range(0, len(words), SLICE):
            piece = words[start : start + SLICE]
            if previous != start - 1:
                state = length = 0
            for at, now, matched in automaton.statistics(piece, state, length):
                place = start + at
                if length and (place != previous + 1 or matched <= length):
                    self._anchor(anchors, previous + 1, state, length)
                for number, size in automaton.whole[now]:
                    if size <= matched:
                        if number >= self.count:
                            places.append({"label": self.labels[number], "first": place - size + 1, "words": size})
                        else:
                            anchors.setdefault(number, []).append((place + 1, size, size))
                state, length, previous = now, matched, place
        if length:
            self._anchor(anchors, previous + 1, state, length)
        spans, best = [], 1.0 if places else 0.0
        for number in sorted(anchors):
            for first, last, covered in chains(anchors[number]):
                share = covered / self.size[number]
                best = max(best, share)
                if share >= SHARE:
                    spans.append({"label": self.labels[number], "template": number, "first": first, "last": last,
                                  "covered": covered, "share": share})
        return places, spans, best

    def _anchor(self, anchors: dict, end: int, state: int, length: int) -> None:
        if length >= LONG:
            for number, stop in self.automaton.ends[state]:
                if number < self.count:
                    anchors.setdefault(number, []).append((end, stop, length))


def chains(anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, last word, template words covered) of chains of (end in text, end in template, length), best first.

    A match may follow one that ends before it in text and template, at most GAP words of the text earlier than it begins;
    it adds the words by which it reaches further in both. Every match is in one chain at most.
    """
    anchors = sorted(set(anchors))
    score, back = [], []
    for i, (end, stop, length) in enumerate(anchors):
        best, before = length, -1
        j = i - 1
        while j >= 0 and end - length - anchors[j][0] <= GAP:
            gain = min(length, end - anchors[j][0], stop - anchors[j][1])
            if gain > 0 and score[j] + gain > best:
                best, before = score[j] + gain, j
            j -= 1
        score.append(best)
        back.append(before)
    used, found = [False] * len(anchors), []
    taken: list[tuple[int, int]] = []
    for i in sorted(range(len(anchors)), key=lambda i: (-score[i], anchors[i])):
        first, at, whole = i, i, True
        while at >= 0:
            whole &= not used[at]
            first, at = at, back[at]
        first, last = anchors[first][0] - anchors[first][2], anchors[i][0] - 1
        at = i
        while at >= 0 and not used[at]:
            used[at] = True
            at = back[at]
        if whole:
            at = bisect_left(taken, (first, first))  # spans taken so far are disjoint, so only the neighbours can overlap
            if all(b < first or a > last for a, b in taken[max(at - 1, 0) : at + 1]):
                taken.insert(at, (first, last))
                found.append((first, last, score[i]))
    return found


PLACE = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())])
SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()),
                  ("covered", pa.int64()), ("share", pa.float64())])


def scan_licences(docs: DataFrame, keep: list[str], templates: list[tuple[str, str]] = TEMPLATES,
                  phrases: dict[str, str] = PHRASES) -> DataFrame:
    """The columns `keep` of every row with n_words, places of phrases, spans of templates and score, the greatest share covered."""
    scanner = Scanner(templates, phrases)

    def scan(texts: list[bytes | None]) -> list[pa.Array]:
        sizes, places, spans, scores = [], [], [], []
        for text in texts:
            words = [w for w in words_of(text) if w]
            here, covered, best = scanner.scan(words)
            sizes.append(len(words))
            places.append(here)
            spans.append(covered)
            scores.append(best)
        return [pa.array(sizes, pa.int64()), pa.array(places, pa.list_(PLACE)), pa.array(spans, pa.list_(SPAN)),
                pa.array(scores, pa.float64())]

    outputs = StructType.fromDDL(
        "n_words bigint, places array<struct<label: string, first: bigint, words: bigint>>, "
        "spans array<struct<label: string, template: int, first: bigint, last: bigint, covered: bigint, share: double>>, "
        "score double")
    return over_texts(docs, keep, outputs, scan)
