"""License scans by a generalised suffix automaton of licence words.

The automaton is that of all templates and phrases together; each of its states has a transition for every licence word, with suffix links
resolved beforehand. A text's words pass through it, and at each word its state and a length, the matching statistic, tell the longest run of words up to there that
any template holds. A word that no template has resets it, so only runs of two or more licence words are streamed, all runs of a block in step. A
phrase stands wherever the statistic is long enough and the state's suffixes have the phrase.

Matches that can't be longer and have LEAST words or more are chained for each template: forwards in text and template, at most GAP words apart in the text. The best
chain's words, as a share of the template's, is the template's score; with COVERED of it the text has the template's label.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_slices, utf8_list
from .text import Lines, alnum_words

#: Labels with their phrases.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Labels with passages of public licences.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
#: Words of a match that is chained, words between two matches of a chain, share of a template that gives its label.
LEAST, GAP, COVERED = 4, 12, 0.6


class Automaton:
    """Of texts given as words. State 0 is the root; word 0 is any that the texts don't have."""

    def __init__(self, phrases, templates):
        named = lambda t: [w.decode() for w in _words(t)]
        self.phrases = [(named(t), label) for label, t in phrases]
        self.templates = [(named(t), label) for label, t in templates]
        every = [t for t, _ in self.phrases + self.templates]
        self.words = sorted({w for t in every for w in t})
        code = {w: i + 1 for i, w in enumerate(self.words)}
        #: One more state for each word read, or two; next states by word, suffix links, longest lengths, and the places (text, end) a state was made at.
        nxt: list[dict[int, int]] = [{}]
        link, length, ends = [-1], [0], [[]]

        def extend(last: int, w: int, place: tuple[int, int]) -> int:
            if w in nxt[last]:  # the texts before hold this already
                q = nxt[last][w]
                if length[q] != length[last] + 1:
                    q = split(last, q, w)
                ends[q].append(place)
                return q
            new = len(nxt)
            nxt.append({}), link.append(0), length.append(length[last] + 1), ends.append([place])
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else split(p, q, w)
            return new

        def split(p: int, q: int, w: int) -> int:
            copy = len(nxt)
            nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1), ends.append([])
            link[q] = copy
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = copy
                p = link[p]
            return copy

        for t, text in enumerate(every):
            last = 0
            for i, w in enumerate(text):
                last = extend(last, code[w], (t, i + 1))
        order = np.argsort(length, kind="stable")
        n, k = len(nxt), len(self.words) + 1
        #: Where a word leads, and the longest length of the state that it leads from, after as many links as it takes.
        self.to, self.most = np.zeros((n, k), np.int32), np.zeros((n, k), np.int32)
        for v in order:
            if v:
                self.to[v], self.most[v] = self.to[link[v]], self.most[link[v]]
            for w, q in nxt[v].items():
                self.to[v, w], self.most[v, w] = q, length[v]
        self.most[:, 0] = -1
        for v in order:
            miss = self.to[v] == 0
            self.most[v, miss] = -1
        self.length, self.link = np.asarray(length), link
        for v in order[::-1]:  # where a state's longest run ends in the texts
            if v and link[v] > 0:
                ends[link[v]] = ends[link[v]] + ends[v]
        first = len(self.phrases)
        self.ends = [[(t - first, e) for t, e in dict.fromkeys(x) if t >= first] for x in ends]
        #: For each phrase how long the statistic has to be in a state for the phrase to stand there (none: very long).
        self.phrase_at = np.full((len(self.phrases), n), 1 << 30, np.int64)
        for i, (text, _) in enumerate(self.phrases):
            v = 0
            for w in text:
                v = nxt[v][code[w]]
            for s in range(n):
                u = s
                while u > 0 and u != v:
                    u = link[u]
                if u == v:
                    self.phrase_at[i, s] = len(text)
        self.table = pa.array(self.words, pa.string())

    def codes(self, x: Lines) -> np.ndarray:
        """Each word's number."""
        if not len(x.start):
            return np.zeros(0, np.int64)
        longest = max(map(len, self.words))
        out = np.zeros(len(x.start), np.int64)
        short = np.flatnonzero(x.end - x.start <= longest)
        size = (x.end - x.start)[short]
        at = np.repeat(x.start[short] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        words = pa.Array.from_buffers(pa.string(), len(short), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(x.raw[at])])
        out[short] = pc.fill_null(pc.index_in(words, self.table), -1).to_numpy() + 1
        return out

    def stream(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, statistic) after each word; first: where each text begins. All runs of two or more licence words go in step."""
        state, stat = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        known = code > 0
        start = known.copy()
        start[1:] &= ~known[:-1]
        begins = first[first < len(code)]
        start[begins] = known[begins]
        start = np.flatnonzero(start)
        end = np.ones(len(code) + 1, bool)
        end[: len(code)] = ~known
        end[begins] = True
        end = np.flatnonzero(end)
        size = end[np.searchsorted(end, start, side="right")] - start
        long = np.flatnonzero(size >= 2)
        long = long[np.argsort(-size[long], kind="stable")]
        at, size = start[long], size[long]
        s, n = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            live = np.searchsorted(-size, -j, side="left")  # how many have more than j words
            w = code[at[:live] + j]
            n[:live] = np.minimum(n[:live], self.most[s[:live], w]) + 1
            s[:live] = self.to[s[:live], w]
            state[at[:live] + j], stat[at[:live] + j] = s[:live], n[:live]
        return state, stat

    def covered(self, ends: list[int], lengths: list[int], states: list[int]) -> dict[int, int]:
        """For each template how many of its words the best chain of a text's matches covers."""
        chains: dict[int, list] = defaultdict(list)
        best: dict[int, int] = {}
        for end, n, v in zip(ends, lengths, states, strict=True):
            for t, te in self.ends[v]:
                ts, ds, score = te - n, end - n, n
                held = [c for c in chains[t] if c[1] >= ds - GAP]
                for ds0, de0, ts0, te0, sum0 in held:
                    if ds0 < ds and ts0 < ts and te0 < te and de0 < end:
                        score = max(score, sum0 + n - max(0, de0 - ds, te0 - ts))
                held.append((ds, end, ts, te, score))
                chains[t] = held
                best[t] = max(best.get(t, 0), score)
        return best


def _words(text: str) -> list[bytes]:
    x = alnum_words([text.encode()])
    return [x.raw[a:b].tobytes() for a, b in zip(x.start, x.end, strict=True)]


@lru_cache(4)
def automaton(phrases=PHRASES, templates=TEMPLATES) -> Automaton:
    return Automaton(phrases, templates)


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, least: int = LEAST, covered: float = COVERED) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row, in one pass without a shuffle.

    n_base counts the places of all phrases, first_word and last_word are the smallest and largest word number at which one begins (null without); labels
    are the phrases' and those of templates of which enough is covered, each once, sorted and joined by commas; score: the greatest covered share of any template. A null or
    empty text has no words, 0 and ''. Repeated rows and ids stay; an empty table gives an empty result; other columns are not read.
    """

    def run(batches):
        a = automaton(phrases, templates)
        size = [len(t) for t, _ in a.templates]
        for b in text_slices(batches, text_col):
            x = alnum_words(utf8_list(b.column(text_col)))
            state, stat = a.stream(a.codes(x), x.first[:-1])
            text = np.searchsorted(x.first, np.arange(len(state)), side="right") - 1
            n_base, labels = np.zeros(b.num_rows, np.int64), [set() for _ in range(b.num_rows)]
            low, high = np.full(b.num_rows, 1 << 62), np.full(b.num_rows, -1)
            for i, (phrase, label) in enumerate(a.phrases):
                at = np.flatnonzero(stat >= a.phrase_at[i, state])
                begin = at - len(phrase) + 1 - x.first[text[at]]
                np.add.at(n_base, text[at], 1)
                np.minimum.at(low, text[at], begin)
                np.maximum.at(high, text[at], begin)
                for d in np.unique(text[at]):
                    labels[d].add(label)
            base = [",".join(sorted(s)) for s in labels]
            # matches that the next word doesn't lengthen
            last = stat >= least
            last[:-1] &= ~((stat[1:] == stat[:-1] + 1) & (text[1:] == text[:-1]))
            last = np.flatnonzero(last)
            score = np.zeros(b.num_rows)
            cut = np.searchsorted(text[last], np.arange(b.num_rows + 1))
            for d in np.flatnonzero(np.diff(cut)):
                of = last[cut[d] : cut[d + 1]]
                for t, n in a.covered((of + 1).tolist(), stat[of].tolist(), state[of].tolist()).items():
                    score[d] = max(score[d], n / size[t])
                    if n >= covered * size[t]:
                        labels[d].add(a.templates[t][1])
            none = n_base == 0
            yield pa.record_batch([
                b.column(id_col), pa.array(np.diff(x.first)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                pa.array(base, pa.string()), pa.array([",".join(sorted(s)) for s in labels], pa.string()), pa.array(score),
            ], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
