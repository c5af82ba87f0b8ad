"""Licence phrases and templates, and the automaton that finds passages of templates in word streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Phrases that are labels by themselves.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and grants of public licences, by label; a label may have several.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

#: Words of a match that counts, share of a template that a chain must cover, words that may stand between matches of a chain.
MIN_WORDS, MIN_COVER, MAX_GAP = 4, 0.8, 40

#: Lower-cases A-Z and makes every other ASCII character that is no letter or digit a space; bytes from 0x80 on stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences; each state knows where its passage first ends in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, end)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            above = self.ends[self.link[state]]
            for number, end in self.ends[state].items():
                above[number] = min(end, above.get(number, end))

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """A state for the passages of target that reach it over `at`."""
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (target := self.next[last].get(word)) is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def maximal_matches(self, words: list[int]) -> list[tuple[int, int, dict[int, int]]]:
        """(end, length, first ends by sequence) of matches that the next word doesn't prolong, of MIN_WORDS at least."""
        state = length = 0
        found = []
        for at, word in enumerate([*words, -2]):
            if word not in self.next[state]:
                if length >= MIN_WORDS:
                    found.append((at, length, self.ends[state]))
                while state > 0 and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
        return found


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES):
        self.number: dict[bytes, int] = {}
        learn = lambda text: [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
        self.templates = [(label, learn(text)) for label, text in templates]
        self.phrases = [(label, np.array(learn(phrase))) for phrase, label in phrases.items()]
        self.automaton = Automaton([words for _, words in self.templates])

    def _end_after(self, number: int, passage: list[int], after: int) -> int:
        """Where the passage next ends in the template beyond `after` words; 0 if nowhere."""
        words, n = self.templates[number][1], len(passage)
        return next((e for e in range(max(n, after + 1), len(words) + 1) if words[e - n : e] == passage), 0)

    def chains(self, runs: list[tuple[int, list[int]]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered share of the template) for each chain over matches in template order.

        runs are (first word, words) of a text in order. A chain goes on over the
        words between runs, MAX_GAP at most between two matches.
        """
        open_: dict[int, list[int]] = {}
        done = []
        for at, words in runs:
            for end, length, ends in self.automaton.maximal_matches(words):
                passage, start, end = words[end - length : end], at + end - length, at + end
                for number, stop in ends.items():
                    chain = open_.get(number)
                    near = chain and start - chain[1] <= MAX_GAP
                    if near and stop <= chain[2]:
                        stop = self._end_after(number, passage, chain[2]) or stop
                    if near and stop > chain[2]:
                        chain[3] += min(length, stop - max(chain[2], stop - length))
                        chain[1:3] = end, stop
                    else:
                        if chain:
                            done.append((number, *chain))
                        open_[number] = [start, end, stop, length]
        done += [(number, *chain) for number, chain in open_.items()]
        return [(self.templates[number][0], first, end, min(1.0, covered / len(self.templates[number][1]))) for number, first, end, _, covered in done]

    def scan(self, texts: list[str | None]) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each text."""
        lists = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        coded = pa.array([w for words in lists for w in words], pa.binary()).dictionary_encode()
        known = np.array([self.number.get(w, -1) for w in coded.dictionary.to_pylist()] + [-1])
        codes = known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(lists) else []
        return [self._scan_one(codes[a : a + n]) for a, n in zip(starts, sizes)]

    def _scan_one(self, codes: np.ndarray) -> tuple:
        places, base = [], set()
        for label, phrase in self.phrases:
            n = len(codes) - len(phrase) + 1
            if n > 0:
                hit = codes[:n] == phrase[0]
                for k in range(1, len(phrase)):
                    hit &= codes[k : n + k] == phrase[k]
                if hit.any():
                    places.append(np.flatnonzero(hit))
                    base.add(label)
        first = int(min(p[0] for p in places)) if places else None
        last = int(max(p[-1] for p in places)) if places else None
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        # runs of words that templates have at all
        spans = self.chains([(a, codes[a:b].tolist()) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= MIN_WORDS])
        score = max((s[3] for s in spans), default=0.0)
        spans = [s for s in spans if s[3] >= MIN_COVER]
        labels = base | {s[0] for s in spans}
        return len(codes), sum(map(len, places)), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans
