"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. A file's words are streamed
through it: after each word it knows the longest run ending there that occurs in some
template (the matching statistics). Runs that can't be prolonged are chained, per
template, in the order of both texts; a chain that covers enough of its template is a
span and gives the template's label. Short phrases are templates whose every whole
occurrence counts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrase -> label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and openings of common licences, as their texts have them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
COVER = 0.8
LEAST = 3
GAP = 16
PIECE = 1 << 20
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, "
    "score double, spans array<struct<label: string, first: bigint, last: bigint, cover: double>>"
)
#: letters and digits stay, A-Z become lower case, all other ASCII separates words
_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def word_list(raw: bytes) -> list[bytes]:
    return raw.translate(_CLEAN).split()


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a piece at a time; a piece ends where a word ends."""
    if len(raw) <= PIECE:
        yield word_list(raw)
        return
    clean, at = raw.translate(_CLEAN), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


class Automaton:
    """Suffix automaton over word sequences; a state stands for runs with the same ends."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, text in enumerate(texts):
            last = 0
            for place, word in enumerate(text):
                last = self._extend(last, word, ends)
                ends[last].append((number, place + 1))
        # an end of a state is an end of its suffixes: hand them down, longest runs first
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            ends[self.link[state]] += ends[state]
        self.ends = [sorted(set(e)) for e in ends]
        self.words = set(self.next[0])

    def _new(self, length: int, nexts: dict, link: int, ends: list) -> int:
        self.length.append(length)
        self.next.append(nexts)
        self.link.append(link)
        ends.append([])
        return len(self.length) - 1

    def _split(self, state: int, word: bytes, ends: list) -> int:
        """The state of (longest run of ``state``) + word, cut off from longer runs."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target], ends)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        new = self._new(self.length[last] + 1, {}, 0, ends)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, ends)
        return new


@dataclass
class _Chain:
    """Best chains of one template: reach of each recent match, and finished spans."""

    label: str
    size: int
    recent: deque = field(default_factory=deque)
    best: float = 0.0
    spans: list = field(default_factory=list)

    def add(self, x: int, t: int, n: int) -> None:
        """A run of ``n`` words at word ``x`` of the file and word ``t`` of the template."""
        while self.recent and x - self.recent[0][1] > GAP:
            self.recent.popleft()
        covered, first = n, x
        for _, x_end, t_end, c, f in self.recent:
            over = max(0, x_end - x, t_end - t)
            if over < n and c + n - over > covered:
                covered, first = c + n - over, f
        self.recent.append((x, x + n, t + n, covered, first))
        share = covered / self.size
        self.best = max(self.best, share)
        if share >= COVER:
            span = (first, x + n - 1, share)
            if self.spans and first <= self.spans[-1][1]:
                self.spans[-1] = max(self.spans[-1], span, key=lambda s: s[2])
            else:
                self.spans.append(span)


class Scanner:
    """Scans one text after the other with one automaton."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates=TEMPLATES):
        known = [(label, word_list(p.encode()), True) for p, label in phrases.items()]
        known += [(label, word_list(t.encode()), False) for label, t in templates]
        self.auto = a = Automaton([w for _, w, _ in known])
        self.known = known
        whole: list[list[tuple[int, int]]] = [[] for _ in a.length]
        for number, (_, text, phrase) in enumerate(known):
            state = 0
            for word in text:
                state = a.next[state][word]
            if phrase:
                whole[state].append((len(text), number))
        # phrases that end where a run of the state ends: its own and those of its suffixes
        self.whole: list[list[tuple[int, int]]] = [[] for _ in whole]
        for state in sorted(range(len(whole)), key=a.length.__getitem__):
            self.whole[state] = whole[state] + (self.whole[a.link[state]] if state else [])
        self.ends = [[(n, e) for n, e in ends if not known[n][2]] if a.length[s] >= LEAST else [] for s, ends in enumerate(a.ends)]

    def scan(self, raw: bytes) -> tuple:
        a, whole, least = self.auto, self.whole, LEAST
        nexts, links, lengths, root = a.next, a.link, a.length, a.next[0]
        chains: dict[int, _Chain] = {}
        places = [0, None, None]
        base: set[str] = set()

        def close(end: int, run: int, state: int) -> None:
            for number, t_end in self.ends[state]:
                if number not in chains:
                    chains[number] = _Chain(self.known[number][0], len(self.known[number][1]))
                chains[number].add(end - run, t_end - run, run)

        state = run = at = 0
        before = -2
        for words in _pieces(raw):
            for i, word in enumerate(words, at):
                if word not in root:
                    continue
                if i != before + 1 and run:
                    if run >= least:
                        close(before + 1, run, state)
                    state = run = 0
                before = i
                step = nexts[state].get(word)
                if step is None:
                    if run >= least:
                        close(i, run, state)
                    while step is None:
                        state = links[state]
                        step = nexts[state].get(word)
                    run = lengths[state]
                state, run = step, run + 1
                for size, number in whole[state]:
                    if size <= run:
                        start = i - size + 1
                        places[0] += 1
                        places[1] = start if places[1] is None else min(places[1], start)
                        places[2] = start if places[2] is None else max(places[2], start)
                        base.add(self.known[number][0])
            at += len(words)
        if run >= least:
            close(before + 1, run, state)
        spans = sorted((s[0], s[1], c.label, s[2]) for c in chains.values() for s in c.spans)
        score = max([1.0 if base else 0.0, *(c.best for c in chains.values())])
        return at, *places, sorted(base), sorted(base | {s[2] for s in spans}), min(1.0, score), [
            {"label": s[2], "first": s[0], "last": s[1], "cover": min(1.0, s[3])} for s in spans]


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """Licence findings of every row of ``docs`` (doc_id, text).

    n_words; n_base, first_word, last_word and base_labels of the phrases' places (no
    place: 0 and nulls, no labels); labels, these and the templates'; score, the largest
    share of a phrase or template that is covered; spans, where a template is covered
    (words from 0). Null is the empty text; a text is read in pieces, its memory beside
    the text is bounded by a piece and the spans. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = [scanner.scan(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
            kinds.append(pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return raw.mapInArrow(run, SCHEMA)
