"""Licence notices in documents, by matching statistics of a suffix automaton over all licence texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm.byte_words import flat, spans, split
from tablescout.llm.common import in_batches, query, table
from tablescout.llm.decontamination import IN_WORD, LOWER, Vocabulary, words_of

#: Phrases whose places are always counted, and the label of each.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Names and notices of licences as their publishers word them. Those of fewer than LEAST words are found
#: as they are, the others also with words left out, put in or changed.
LICENCES = [
    ("mit", "MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
     "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
     "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
     "shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at"),
    ("bsd", "BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("isc", "ISC License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0", "Creative Commons Zero"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "CC BY-NC-SA"),
    ("cc-by-nc-sa", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "CC BY-NC-ND"),
    ("cc-by-nc-nd", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
]
#: Words of a match that can be a link of a chain, words that may lie between two links, and the share of a licence's
#: words that a chain must cover.
LEAST, GAP, COVERED = 4, 12, 0.8

RESULT = (
    "n_words long, base array<struct<label:string,first:long>>, "
    "spans array<struct<label:string,first:long,last:long,share:double>>, score double"
)


class Automaton:
    """Generalised suffix automaton of sequences of numbers: each state stands for substrings that end at the same places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extended(last, symbol)
                self.ends[last].add((which, at + 1))
        # A state's places are also those of the state of its longest suffix with more places.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, symbol: int) -> int:
        """The state of the string of ``state`` and the symbol alone, which the target of that step may share with longer ones."""
        target = self.next[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        own = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = own
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = own
            state = self.link[state]
        return own

    def _extended(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        self.link[new] = self._split(state, symbol) if state >= 0 else 0
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest suffix of what is read that occurs in a sequence, after each symbol."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            yield state, length


@dataclass
class Segment:
    """Words of a document from ``first`` on that are those of a licence from ``at`` on."""

    first: int
    at: int
    words: int


def chains(segments: list[Segment], longest: int) -> list[tuple[int, int, int]]:
    """First word, last word (exclusive) and covered words of the best chain from each segment that begins one.

    Links follow each other in the document and in the licence, at most GAP words apart in the document; what two
    links share counts once.
    """
    segments = sorted(segments, key=lambda s: (s.first, s.at))
    covered, start, best = [], [], {}
    for i, s in enumerate(segments):
        most, begin = s.words, s.first
        for j in range(i - 1, -1, -1):
            p = segments[j]
            if p.first + longest + GAP < s.first:
                break
            if p.first < s.first <= p.first + p.words + GAP and p.at < s.at:
                new = s.words - max(0, p.first + p.words - s.first, p.at + p.words - s.at)
                if new > 0 and covered[j] + new > most:
                    most, begin = covered[j] + new, start[j]
        covered.append(most)
        start.append(begin)
        if most > best.get(begin, (0, 0))[1]:
            best[begin] = (s.first + s.words, most)
    return [(begin, end, most) for begin, (end, most) in best.items()]


class Scanner:
    """Finds base phrases and licences in sequences of words."""

    def __init__(self, licences: list[tuple[str, str]], base: list[tuple[str, str]]):
        texts = [(label, words_of(text)) for label, text in [*base, *licences]]
        if any(len(words) < 2 for _, words in texts):
            raise ValueError("phrases and licences need two words at least")
        numbers: dict[str, int] = {}
        self.sequences = [[numbers.setdefault(w, len(numbers)) for w in words] for _, words in texts]
        self.labels, self.n_base = [label for label, _ in texts], len(base)
        self.words = [w.encode() for w in numbers]
        self.automaton = Automaton(self.sequences)
        self.pairs = np.unique([a * len(numbers) + b for s in self.sequences for a, b in zip(s, s[1:])]).astype(np.int64)
        #: By state, the short sequences that end with its strings, and their words.
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for which, sequence in enumerate(self.sequences):
            if which < self.n_base or len(sequence) < LEAST:
                state = 0
                for symbol in sequence:
                    state = self.automaton.next[state][symbol]
                self.whole[state].append((which, len(sequence)))
        for state in sorted(range(1, len(self.whole)), key=self.automaton.length.__getitem__):
            self.whole[state] = self.whole[state] + self.whole[self.automaton.link[state]]

    def matches(self, symbols: list[int], offset: int) -> tuple[list[tuple[int, int]], dict[int, list[Segment]]]:
        """Short sequences with their first words, and the longest matches with each other licence."""
        whole, found, running = [], defaultdict(list), {}
        automaton = self.automaton
        for at, (state, length) in enumerate(automaton.statistics(symbols), offset + 1):
            whole += [(which, at - n) for which, n in self.whole[state] if n <= length]
            ending: dict[tuple[int, int], Segment] = {}
            while length >= LEAST:
                for which, end in automaton.ends[state]:
                    diagonal = (which, at - end)
                    if diagonal not in ending and which >= self.n_base:
                        segment = running.get(diagonal) or Segment(at - length, end - length, 0)
                        segment.words = at - segment.first
                        ending[diagonal] = segment
                state = automaton.link[state]
                length = automaton.length[state]
            for diagonal in running.keys() - ending.keys():
                found[diagonal[0]].append(running[diagonal])
            running = ending
        for (which, _), segment in running.items():
            found[which].append(segment)
        return whole, found

    def scan(self, stretches: list[tuple[int, list[int]]]) -> tuple[list, list, float]:
        """Base places, licence spans and score of a document from its stretches of licence words."""
        base, spans, score = [], [], 0.0
        segments: dict[int, list[Segment]] = defaultdict(list)
        for offset, symbols in stretches:
            whole, found = self.matches(symbols, offset)
            for which, first in whole:
                score = 1.0
                if which < self.n_base:
                    base.append((first, which))
                else:
                    spans.append((len(self.sequences[which]), 1.0, first, first + len(self.sequences[which]), which))
            for which, some in found.items():
                segments[which] += some
        for which, some in segments.items():
            n = len(self.sequences[which])
            for first, last, covered in chains(some, n):
                score = max(score, covered / n)
                if covered >= COVERED * n:
                    spans.append((covered, covered / n, first, last, which))
        base = [{"label": self.labels[which], "first": first} for first, which in sorted(base)]
        return base, self._chosen(spans), score

    def _chosen(self, spans: list[tuple]) -> list[dict]:
        """Spans of which no more than half lies in one that covers more words, so that the nearest version is named."""
        kept: list[tuple] = []
        taken: dict[int, list[tuple]] = defaultdict(list)
        cell = max(map(len, self.sequences)) + GAP * max(map(len, self.sequences))
        for span in sorted(spans, key=lambda s: (-s[0], -s[1], s[2], self.labels[s[4]])):
            first, last = span[2:4]
            near = {k for c in range(first // cell - 1, last // cell + 1) for k in taken[c]}
            if all(2 * (min(last, k[3]) - max(first, k[2])) <= last - first for k in near):
                kept.append(span)
                for c in range(first // cell, (last - 1) // cell + 1):
                    taken[c].append(span)
        return [{"label": self.labels[w], "first": a, "last": b, "share": share} for _, share, a, b, w in sorted(kept, key=lambda s: (s[2], s[3], s[4]))]


def scan_batch(scanner: Scanner, vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, list, list, list]:
    """Words, base places, spans and score of each text.

    A match of two words or more lies in a stretch of words whose neighbours stand side by side in some licence;
    elsewhere the matching statistics are 0 or 1, so only such stretches are streamed through the automaton.
    """
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends = spans(IN_WORD[data], offsets)
    first = np.searchsorted(starts, offsets)
    n = len(texts)
    base, found, scores = [[] for _ in range(n)], [[] for _ in range(n)], [0.0] * n
    if len(starts) > 1:
        numbers = vocabulary.numbers(data, starts, ends) - 2
        pair = (numbers[:-1] >= 0) & (numbers[1:] >= 0)
        inner = first[(first > 0) & (first < len(numbers))]
        pair[inner - 1] = False
        maybe = np.flatnonzero(pair)
        keys = numbers[maybe] * len(vocabulary.words) + numbers[maybe + 1]
        pair[maybe] = scanner.pairs[np.minimum(np.searchsorted(scanner.pairs, keys), len(scanner.pairs) - 1)] == keys
        begin, end = spans(pair, np.array([0, len(pair)]))
        doc = np.searchsorted(first, begin, side="right") - 1
        stretches: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist()):
            stretches[d].append((a - int(first[d]), numbers[a : b + 1].tolist()))
        for d, some in stretches.items():
            base[d], found[d], scores[d] = scanner.scan(some)
    return np.diff(first), base, found, scores


def scan(docs: DataFrame, licences: list[tuple[str, str]] = LICENCES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """Licences of whole documents: doc_id, n_words, base, spans and score.

    All phrases and licences are sequences of words in one suffix automaton, which is bounded by their texts. Each task
    streams its documents through it: after every word it has the longest suffix that occurs in a licence, and with
    it, over shorter suffixes, the longest match with each licence. Matches of LEAST words are chained, in the order of
    document and licence and with gaps of at most GAP words; a chain that covers the share COVERED of a licence is a
    span of it. Of spans that overlap by more than half, the one that covers most words stays, so versions of a
    licence exclude each other. No document leaves its task.

    ``base`` holds the label and first word of every place of a base phrase; ``spans`` the label, first and last word
    (exclusive) and covered share of every licence; ``score`` the largest share that was covered, below COVERED too.

    Words are runs of letters, digits and characters outside ASCII, A-Z lower-cased. Null and empty texts have no
    words and a score of 0. Repeated rows are returned each, missing identifiers stay missing, an empty table gives
    no rows, and further columns are not looked at.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(list(licences), list(base)))
    kinds = [
        pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())])),
        pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])),
        pa.float64(),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner.value
        vocabulary = Vocabulary(own.words)
        for whole in batches:
            for batch in split(whole, 1):
                counts, *rest = scan_batch(own, vocabulary, batch.column(1))
                columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(x, kind) for x, kind in zip(rest, kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "base", "spans", "score"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(in_batches(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


@query("op11_licences")
def op11_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"),
        joined("base.label").alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        "score",
        "spans",
    )
