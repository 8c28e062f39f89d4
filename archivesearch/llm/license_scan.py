"""Licence scan with a generalised suffix automaton over the words of licence templates.

Every text is streamed through the automaton once. The matching statistics (the longest template
substring ending at each word) and the suffix links give the maximal matches of every template, also
those that end inside a longer match of another one; matches of a template that advance in both
text and template are chained over small gaps, and a chain that covers enough of its template is a
template span. Words that a span with more words of another template has matched count for that one:
a span that is not its whole template word by word, and covers too little without them, is left out
('licensed under the' of an Apache notice is no MIT notice). The base phrases are strings of the same
automaton, and every place of them is found from the same statistics.

Defined results: a null or empty text has no words, no labels, score 0. Repeated rows each get a
row. Texts are scanned whole; the chains held at a time are bounded by the templates, not by the
text. Extra columns are carried along; those named like a result column are left out. Ties
between chains go to the one that starts first in the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivesearch.llm.shared import col, free_name, without

#: Phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices -> label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
                   "express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and "
            "the following disclaimer"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version"),
    ("gpl", "Distributed under the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
_RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, spans array<struct<label: string, first_word: long, last_word: long, coverage: double>>")

# ASCII bytes that are no digit or letter part words; all other bytes belong to words.
_TO_SPACE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


@dataclass(frozen=True)
class Rules:
    """``min_match``: words of the shortest match that may join a chain; ``max_gap``: words skipped
    in text or template between two links; ``min_cover``: share of a template that a span covers."""

    templates: tuple = TEMPLATES
    min_match: int = 3
    max_gap: int = 6
    min_cover: float = 0.6


class Automaton:
    """Suffix automaton of several word strings; each state knows where its strings end."""

    def __init__(self, strings: list[list[bytes]]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set] = [set()]
        for number, words in enumerate(strings):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                self.ends[last].add((number, at + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, nexts: dict, link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of ``q`` for the strings that reach it from ``p`` or its suffixes."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # already there from another string
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(index of a word, state, length of the longest match that ends with it), matches only."""
        state = matched = 0
        get, nexts = self.ids.get, self.next
        for at, word in enumerate(words):
            number = get(word)
            if number is None:
                state = matched = 0
                continue
            while state and number not in nexts[state]:
                state = self.link[state]
                matched = self.length[state]
            if number in nexts[state]:
                state = nexts[state][number]
                matched += 1
                yield at, state, matched


class Scanner:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.labels = [label for label, _ in rules.templates] + list(BASE.values())
        strings = [words_of(text) for _, text in rules.templates] + [words_of(p) for p in BASE]
        self.sizes = [len(s) for s in strings]
        self.first_base = len(rules.templates)
        self.automaton = Automaton(strings)
        # Of each state: the base phrases that its strings end with, its own and those of its suffixes.
        self.phrases: list[list[int]] = [[] for _ in self.automaton.link]
        for n in range(self.first_base, len(strings)):
            state = 0
            for word in strings[n]:
                state = self.automaton.next[state][self.automaton.ids[word]]
            self.phrases[state].append(n)
        for state in sorted(range(1, len(self.phrases)), key=lambda s: self.automaton.length[s]):
            self.phrases[state] += self.phrases[self.automaton.link[state]]
        # Of each state: (template, end, word that follows there) of its longest strings, and with their
        # length those of its suffixes that the longer strings do not end with.
        self.own: list[list[tuple]] = [[] for _ in self.automaton.link]
        self.inner: list[list[tuple]] = [[] for _ in self.automaton.link]
        follows = {(n, t): s[t] if t < len(s) else None for n, s in enumerate(strings[:self.first_base])
                   for t in range(1, len(s) + 1)}
        for state in sorted(range(1, len(self.own)), key=lambda s: self.automaton.length[s]):
            ends, link = self.automaton.ends, self.automaton.link[state]
            self.own[state] = [(n, t, follows[n, t]) for n, t in sorted(ends[state]) if (n, t) in follows]
            if self.automaton.length[link] >= rules.min_match:
                self.inner[state] = [(n, t, follows[n, t], self.automaton.length[link])
                                     for n, t in sorted(ends[link] - ends[state]) if (n, t) in follows] + self.inner[link]

    def _matches(self, at: int, state: int, length: int, following: bytes | None) -> Iterator[tuple[int, int, int, int]]:
        """(index of the last word, template, its end there, length) of the matches that no further
        word of their own template continues."""
        for number, t_end, word in self.own[state]:
            if word is None or word != following:
                yield at, number, t_end, length
        for number, t_end, word, size in self.inner[state]:
            if word is None or word != following:
                yield at, number, t_end, size

    def _chains(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, coverage) of the chains that cover enough."""
        gap, best = self.rules.max_gap, []
        open_chains: dict[int, list] = defaultdict(list)  # template -> [text end, template end, covered, start, links]
        for end, number, t_end, length in matches:
            # No link is longer than its template: what lies further back is out of reach for good.
            kept = [c for c in open_chains[number] if end + 1 - self.sizes[number] - c[0] <= gap]
            here = (end + 1 - length, end + 1)
            new = [end + 1, t_end, length, here[0], (here, None)]
            for text_end, tmpl_end, covered, start, links in kept:
                # A link may overlap the chain before it; only what it adds counts.
                add = min(end + 1 - text_end, t_end - tmpl_end, length)
                if (add > 0 and here[0] - text_end <= gap and t_end - add - tmpl_end <= gap
                        and (covered + add, -start) > (new[2], -new[3])):
                    new[2:] = [covered + add, start, (here, links)]
            open_chains[number] = [*kept, new]
            coverage = new[2] / self.sizes[number]
            if coverage >= self.rules.min_cover:
                best.append((number, new[3], new[0] - 1, min(1.0, coverage), new[4]))
        spans: dict = {}
        for number, start, end, coverage, links in best:  # of chains with one start, the longest
            if coverage >= spans.get((number, start), (0, 0.0))[1]:
                spans[number, start] = (end, coverage, links)
        found = [(n, s, e, c, links) for (n, s), (e, c, links) in sorted(spans.items(), key=lambda x: (x[0][1], x[0][0]))]
        return [s[:4] for s, mine in zip(found, self._own_words(found)) if mine]

    def _own_words(self, spans: list[tuple]) -> list[bool]:
        """Of each span: whether it is its whole template word by word, or covers enough of it with the
        words that no larger span of another template has."""
        words = []
        for *_, links in spans:
            words.append(set())
            while links:
                (first, end), links = links
                words[-1].update(range(first, end))
        kept, taken = [False] * len(spans), defaultdict(list)  # word -> (size, template) of kept spans
        for place in sorted(range(len(spans)), key=lambda p: -len(words[p])):
            number, mine = spans[place][0], words[place]
            whole = spans[place][4][1] is None and len(mine) == self.sizes[number]
            left = sum(not any(n != number and size > len(mine) for size, n in taken[w]) for w in mine)
            kept[place] = whole or left / self.sizes[number] >= self.rules.min_cover
            if kept[place]:
                for word in mine:
                    taken[word].append((len(mine), number))
        return kept

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        matches, places = [], []
        for at, state, length in self.automaton.statistics(words):
            for n in self.phrases[state]:
                if length >= self.sizes[n]:
                    places.append((at + 1 - self.sizes[n], n))
            if length >= self.rules.min_match:
                matches += self._matches(at, state, length, words[at + 1] if at + 1 < len(words) else None)
        chains = self._chains(matches)
        base = {self.labels[n] for _, n in places}
        spans = [(self.labels[n], start, end, cover) for n, start, end, cover in chains]
        starts = [p for p, _ in places]
        score = 1.0 if places else max((c for *_, c in chains), default=0.0)
        return (len(words), len(places), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score,
                [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in spans])


@lru_cache(maxsize=4)
def scanner(rules: Rules) -> Scanner:
    return Scanner(rules)


def license_scan(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All rows and columns of ``docs`` (but those named as in ``COLUMNS``) with the base counts,
    labels, score and the covered template ``spans`` (words from 0)."""
    carried = without(docs, list(COLUMNS))
    tmp = free_name(docs, "_license")

    @F.pandas_udf(_RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        one = scanner(rules)
        out = pd.DataFrame([one.scan(t or "") for t in texts], columns=list(COLUMNS))
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return (docs.withColumn(tmp, scan.asNondeterministic()(col("text")))
            .select(*[col(c) for c in carried], f"{tmp}.*"))
