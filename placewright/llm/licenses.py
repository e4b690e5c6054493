"""License scan: matching statistics from a suffix automaton of license texts, chained to covered spans.

1. Automaton. The words of all templates and phrases go into one generalised suffix automaton, whose states are
   the word sequences that occur in them, grouped by where they end. It is a few thousand states whatever the
   documents, and is sent to the tasks with their code.
2. Matching statistics. The words of a text stream through it once; at each word the state and the length of the longest
   sequence that ends there and occurs in a template are known. Suffix links give the other templates that
   hold its end. A phrase stands wherever its state is met at its length or more.
3. Chains. Runs of ``MIN_MATCH`` words and more along a template are matches. Per template, matches in the order of
   both text and template are chained if at most ``MAX_GAP`` words lie between them. A chain that covers enough of its template
   (all of a short one, ``COVERED`` of a longer one) is a span, and gives the template's label.

Words are runs of digits, ASCII letters in lower case and whatever is not ASCII. A document is one row, so nothing is shuffled.
The score is the largest share of a template that one chain covers; phrases and short templates count as a whole or not.

Defined cases: a null text is empty and has no words, no place, no label and a score of 0; rows with one or a null
``doc_id`` each give a row; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.tables import shipped, texts

#: Phrases whose every place is told, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices by which texts are put under a license, and labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl", "licensed under the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
    ),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "Creative Commons Attribution 4.0 International"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("cc-by-nd", "Licensed under CC BY-ND"),
    ("cc0", "CC0 1.0 Universal"),
    (
        "no-warranty",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the "
        "warranties of merchantability, fitness for a particular purpose and noninfringement",
    ),
]

#: Words of a match, words between matches of a chain, and words from which a template need not be covered as a whole.
MIN_MATCH, MAX_GAP, LONG = 3, 8, 10
#: Share of a long template that a span covers, and what a word between matches costs a chain.
COVERED, GAP_COST = 0.7, 0.1

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPAN = "struct<label: string, template: int, first_word: long, last_word: long, coverage: double>"
PLACE = "struct<label: string, phrase: string, first_word: long>"
SCANNED = f"doc_id long, n_words long, places array<{PLACE}>, spans array<{SPAN}>, score double"


def words_of(text: str) -> list[bytes]:
    """The words of a text; as bytes, since these change A-Z alone to lower case."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass
class Match:
    """Words ``start`` to ``end`` of a text, equal to those of a template from ``at`` on."""

    start: int
    end: int
    at: int

    @property
    def at_end(self) -> int:
        return self.at + self.end - self.start


@dataclass
class State:
    length: int
    link: int = -1
    following: dict[int, int] = field(default_factory=dict)
    #: Places (template, word) where its sequences end, and phrases (length, number) that these end with.
    ends: list[tuple[int, int]] = field(default_factory=list)
    phrases: list[tuple[int, int]] = field(default_factory=list)


class Automaton:
    """A generalised suffix automaton of templates and phrases."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: dict[str, str]) -> None:
        self.labels = [label for label, _ in templates]
        self.phrases = list(phrases.items())
        texts = [words_of(text) for _, text in templates] + [words_of(phrase) for phrase in phrases]
        self.numbers: dict[bytes, int] = {}
        sequences = [[self.numbers.setdefault(word, len(self.numbers)) for word in text] for text in texts]
        self.sizes = [len(s) for s in sequences]
        self.states = [State(0)]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extended(last, word)
        for number, sequence in enumerate(sequences):
            self._mark(number, sequence)
        for state in sorted(range(1, len(self.states)), key=lambda s: self.states[s].length):
            self.states[state].phrases += self.states[self.states[state].link].phrases

    def _extended(self, last: int, word: int) -> int:
        """The state after one more word of a sequence."""
        states = self.states
        known = states[last].following.get(word)
        if known is not None:  # an earlier sequence went on like this
            if states[known].length == states[last].length + 1:
                return known
            return self._split(last, word, known)
        new = len(states)
        states.append(State(states[last].length + 1))
        at = last
        while at >= 0 and word not in states[at].following:
            states[at].following[word] = new
            at = states[at].link
        if at < 0:
            states[new].link = 0
        else:
            after = states[at].following[word]
            states[new].link = after if states[after].length == states[at].length + 1 else self._split(at, word, after)
        return new

    def _split(self, at: int, word: int, after: int) -> int:
        """A state of its own for the shorter sequences of ``after``."""
        states = self.states
        part = len(states)
        states.append(State(states[at].length + 1, states[after].link, dict(states[after].following)))
        states[after].link = part
        while at >= 0 and states[at].following.get(word) == after:
            states[at].following[word] = part
            at = states[at].link
        return part

    def _mark(self, number: int, sequence: list[int]) -> None:
        state = 0
        for end, word in enumerate(sequence):
            state = self.states[state].following[word]
            if number < len(self.labels):
                at = state
                while at > 0:
                    self.states[at].ends.append((number, end))
                    at = self.states[at].link
        if sequence and number >= len(self.labels):
            self.states[state].phrases.append((len(sequence), number - len(self.labels)))

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """Word, state and length of the longest sequence that ends there, where there is one."""
        states, state, length = self.states, 0, 0
        for i, word in enumerate(map(self.numbers.get, words)):
            if word is None:
                state = length = 0
                continue
            while state and word not in states[state].following:
                state = states[state].link
                length = states[state].length
            following = states[state].following.get(word)
            if following is None:
                state = length = 0
            else:
                state, length = following, length + 1
                yield i, state, length

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, list[Match]]]:
        """Places (phrase, first word) of phrases, and the matches with each template."""
        places: list[tuple[int, int]] = []
        matches: dict[int, list[Match]] = {}
        open_: dict[tuple[int, int], Match] = {}
        for i, state, length in self.statistics(words):
            for size, phrase in self.states[state].phrases:
                if size <= length:
                    places.append((phrase, i - size + 1))
            if length < MIN_MATCH:
                if open_:
                    open_ = {}
                continue
            going: dict[tuple[int, int], Match] = {}
            at, size = state, length
            while size >= MIN_MATCH:
                for template, end in self.states[at].ends:
                    diagonal = (template, i - end)
                    if diagonal in going:
                        continue
                    match = open_.get(diagonal)
                    if match is None or match.end != i - 1:
                        match = Match(i - size + 1, i, end - size + 1)
                        matches.setdefault(template, []).append(match)
                    match.end = i
                    going[diagonal] = match
                at = self.states[at].link
                size = self.states[at].length
            open_ = going
        return places, matches


def chains(matches: list[Match]) -> Iterator[tuple[int, int, int]]:
    """First word, last word and covered words of the best chains of one template; each match is in one of them."""
    matches = sorted(matches, key=lambda m: (m.end, m.at_end))
    best: list[float] = []
    before: list[int] = []
    gained: list[int] = []
    for i, m in enumerate(matches):
        value, previous, gain = float(m.end - m.start + 1), -1, m.end - m.start + 1
        for j in range(i - 1, -1, -1):
            p = matches[j]
            if p.end < m.start - MAX_GAP - 1:  # matches come by their ends
                break
            shared = max(0, p.end + 1 - m.start, p.at_end + 1 - m.at)
            left = m.end - m.start + 1 - shared
            between = (m.start + shared - p.end - 1) + (m.at + shared - p.at_end - 1)
            if left > 0 and between <= 2 * MAX_GAP and best[j] + left - GAP_COST * between > value:
                value, previous, gain = best[j] + left - GAP_COST * between, j, left
        best.append(value)
        before.append(previous)
        gained.append(gain)
    used = [False] * len(matches)
    for i in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
        if used[i]:
            continue
        covered, at, first = 0, i, i
        while at >= 0 and not used[at]:
            used[at], first = True, at
            joined = before[at] >= 0 and not used[before[at]]
            covered += gained[at] if joined else matches[at].end - matches[at].start + 1
            at = before[at]
        yield matches[first].start, matches[i].end, covered


def scanned(automaton: Automaton, text: str) -> tuple[int, list[tuple], list[tuple], float]:
    """Number of words, places of phrases, spans of templates, and the score of one text."""
    words = words_of(text)
    found, matches = automaton.scan(words)
    places = [(automaton.phrases[p][1], automaton.phrases[p][0], at) for p, at in found]
    spans, score = [], 1.0 if places else 0.0
    for template in sorted(matches):
        size = automaton.sizes[template]
        needed = size if size < LONG else COVERED * size
        for first, last, covered in chains(matches[template]):
            if size >= LONG or covered >= needed:
                score = max(score, min(1.0, covered / size))
            if covered >= needed:
                spans.append((automaton.labels[template], template, first, last, min(1.0, covered / size)))
    return len(words), places, sorted(spans, key=lambda s: s[2:4]), score


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None
) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` of phrases, ``spans`` of templates and ``score`` for every row of ``docs``."""
    automaton = Automaton(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    shared = shipped(docs.sparkSession, automaton)
    kinds = {name: kind for name, kind in (("places", PLACE), ("spans", SPAN))}
    types = {name: pa.list_(pa.struct(_fields(kind))) for name, kind in kinds.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared()
        for batch in batches:
            rows = [scanned(known, text) for text in batch.column("text").to_pylist()]
            n_words, places, spans, scores = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array([_dicts(p, types["places"]) for p in places], types["places"]),
                pa.array([_dicts(s, types["spans"]) for s in spans], types["spans"]),
                pa.array(scores, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "places", "spans", "score"])

    return texts(docs).mapInArrow(scan, SCANNED)


def _fields(struct: str) -> list[pa.Field]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    inner = struct.removeprefix("struct<").removesuffix(">")
    return [pa.field(name, kinds[kind]) for name, kind in (part.split(": ") for part in inner.split(", "))]


def _dicts(rows: list[tuple], kind: pa.ListType) -> list[dict]:
    names = [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)]
    return [dict(zip(names, row, strict=True)) for row in rows]


def license_summary(docs: DataFrame) -> DataFrame:
    """One row per document: counts and ends of the places of phrases, and all labels."""
    found = scan_licenses(docs)
    starts = F.transform("places", lambda p: p["first_word"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    every = F.array_union(base, F.transform("spans", lambda s: s["label"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        "score",
    )
