"""Licence scan by a generalised suffix automaton over the words of licence templates.

The automaton is built once from the templates, whose number and length don't depend on the data,
and goes to the tasks as a broadcast. Each file's words are streamed through it; after each word it
knows the longest run of words ending there that any template holds (matching statistics). Runs that
can't be extended are chained, template by template, into spans; a template of which enough is
covered gives its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import Masked, small_batches
from watchlake.llm.tokens import ALNUM, Words, slices, words

# Phrases that count wherever they stand, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licences and of the notices that name them.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-2", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
]

#: Words of a match that takes part in a chain.
MIN_MATCH = 4
#: Share of a template that its chain must cover for the label.
MIN_COVER = 0.75
#: Words that may lie between matches of a chain.
MAX_GAP = 12


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text))


class Automaton:
    """Generalised suffix automaton; state 0 is the empty run.

    `links` leads to the state of the longest shorter suffix, `longest` has the length of a state's
    longest run, `ends` the places (template, last word) at which its runs end.
    """

    def __init__(self, sequences: list[list[int]]):
        self.steps, self.links, self.longest = [{}], [-1], [0]
        last_of: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self._append(state, word)
                last_of += [[] for _ in range(len(self.steps) - len(last_of))]
                last_of[state].append((number, place))
        self.ends = last_of
        for state in sorted(range(1, len(self.steps)), key=lambda s: -self.longest[s]):
            if self.links[state] > 0:
                self.ends[self.links[state]] = self.ends[self.links[state]] + self.ends[state]

    def _state(self, length: int, steps: dict, link: int) -> int:
        self.steps.append(steps)
        self.longest.append(length)
        self.links.append(link)
        return len(self.steps) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """A state of its own for the runs of `child` that reach it from `parent`."""
        copy = self._state(self.longest[parent] + 1, dict(self.steps[child]), self.links[child])
        self.links[child] = copy
        while parent >= 0 and self.steps[parent].get(word) == child:
            self.steps[parent][word] = copy
            parent = self.links[parent]
        return copy

    def _append(self, state: int, word: int) -> int:
        known = self.steps[state].get(word)
        if known is not None:
            if self.longest[known] == self.longest[state] + 1:
                return known
            return self._split(state, word, known)
        new = self._state(self.longest[state] + 1, {}, 0)
        while state >= 0 and word not in self.steps[state]:
            self.steps[state][word] = new
            state = self.links[state]
        if state >= 0:
            child = self.steps[state][word]
            fits = self.longest[child] == self.longest[state] + 1
            self.links[new] = child if fits else self._split(state, word, child)
        return new

    def stream(self, sequence) -> Iterator[tuple[int, int]]:
        """After each word the state and the length of the longest run ending there."""
        state = length = 0
        for word in sequence:
            while state and word not in self.steps[state]:
                state = self.links[state]
                length = self.longest[state]
            state = self.steps[state].get(word, 0)
            length = length + 1 if state else 0
            yield state, length


class Scanner:
    """All that tasks need: the automaton, the templates' words by hash, the phrases."""

    def __init__(self, templates, phrases, min_match=MIN_MATCH, min_cover=MIN_COVER, max_gap=MAX_GAP):
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.labels = [label for label, _ in templates] + list(phrases.values())
        self.n_templates = len(templates)
        texts = [template_words(text) for _, text in templates] + [p.split(" ") for p in phrases]
        if not all(texts):
            raise ValueError("a template without words")
        self.sizes = [len(t) for t in texts]
        vocabulary = sorted({w for t in texts for w in t})
        joined = " ".join(vocabulary).encode()
        data = np.frombuffer(joined + b" ", np.uint8)
        hashes = words(data, np.array([len(data)]), ALNUM).hashes
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = Automaton([[number[w] for w in t] for t in texts])
        self.shortest = min([min_match, *self.sizes[self.n_templates :]])
        # the phrases that are suffixes of a state's runs
        self.phrase_ends = [[] for _ in self.automaton.steps]
        for t in range(self.n_templates, len(texts)):
            state = 0
            for w in texts[t]:
                state = self.automaton.steps[state][number[w]]
            self.phrase_ends[state].append((t, self.sizes[t]))
        for state in sorted(range(1, len(self.phrase_ends)), key=self.automaton.longest.__getitem__):
            self.phrase_ends[state] = self.phrase_ends[state] + self.phrase_ends[self.automaton.links[state]]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the templates, -1 for words they don't have."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Of one file: places (phrase, first word), and spans (template, first, last word, cover)."""
        known = np.diff((numbers >= 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        places, matches = [], []
        for first, last in zip(np.flatnonzero(known == 1), np.flatnonzero(known == -1), strict=True):
            if last - first < self.shortest:
                continue
            state = length = 0
            for i, (after, grown) in enumerate(self.automaton.stream(numbers[first:last].tolist()), int(first)):
                if length >= self.min_match and grown <= length:
                    matches.append((i - length, i - 1, state, length))
                state, length = after, grown
                for phrase, size in self.phrase_ends[state]:
                    if length >= size:
                        places.append((phrase, i - size + 1))
            if length >= self.min_match:
                matches.append((int(last) - length, int(last) - 1, state, length))
        return places, self.chains(matches)

    def chains(self, matches) -> list[tuple[int, int, int, float]]:
        """Chain matches that follow each other in file and template, with small gaps between them."""
        spans = []
        running: dict[int, list[tuple[int, int, int, int]]] = {}
        for first, last, state, length in matches:
            for t, end in self.automaton.ends[state]:
                if t >= self.n_templates:
                    continue
                begin = end - length + 1
                chains = [c for c in running.get(t, ()) if first - c[1] <= self.max_gap]
                spans += [(t, *c) for c in running.get(t, ()) if first - c[1] > self.max_gap]
                best = None
                for c in chains:
                    # only words of the template not yet covered count
                    if c[1] < last and c[2] < end and (best is None or c[3] > best[3]):
                        best = c
                if best:
                    grown = (best[0], last, end, best[3] + end - max(best[2], begin - 1))
                    chains.remove(best)
                    chains.append(grown)
                else:
                    chains.append((first, last, end, length))
                # of chains with one template end, a chain goes if another has as much cover and
                # ends as late in the file; the gap bounds how many stay
                kept, ahead = set(), None
                for i in sorted(range(len(chains)), key=lambda i: (chains[i][2], -chains[i][3], -chains[i][1])):
                    if ahead is None or chains[ahead][2] != chains[i][2] or chains[ahead][1] < chains[i][1]:
                        kept.add(i)
                        ahead = i
                spans += [(t, *c) for i, c in enumerate(chains) if i not in kept]
                running[t] = [c for i, c in enumerate(chains) if i in kept]
        spans += [(t, *c) for t, chains in running.items() for c in chains]
        return [(t, first, last, self._cover(t, first, last, end, covered)) for t, first, last, end, covered in spans]

    def _cover(self, t: int, first: int, last: int, end: int, covered: int) -> float:
        """Share of a template that a chain covers; words put in, not in place of others, count as missing ones."""
        put_in = max(0, last - first - end)
        return min(covered, self.sizes[t]) / (self.sizes[t] + put_in)

    def _best(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of spans that share words of the file those of one label, that of the best covered, then longest one."""
        kept, group, end = [], [], -1
        for span in [*sorted(spans, key=lambda s: s[1]), None]:
            if group and (span is None or span[1] > end):
                taken = []
                for own in sorted(group, key=lambda s: (-s[3], s[1] - s[2], s[0], s[1])):
                    label = self.labels[own[0]]
                    if all(self.labels[o[0]] == label or o[2] < own[1] or o[1] > own[2] for o in taken):
                        taken.append(own)
                kept += taken
                group = []
            if span:
                group.append(span)
                end = max(end, span[2])
        return kept

    def report(self, w: Words, numbers: np.ndarray, doc: int) -> dict:
        own = numbers[w.of(doc)]
        places, spans = self.scan(own)
        covering = self._best([s for s in spans if s[3] >= self.min_cover])
        base = sorted({self.labels[p] for p, _ in places})
        at = [first for _, first in places]
        return {
            "n_words": len(own),
            "n_base": len(places),
            "first_word": min(at, default=None),
            "last_word": max(at, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(self.labels[s[0]] for s in covering)})),
            "score": max([1.0 if places else 0.0, *(s[3] for s in spans)]),
            "spans": [
                {"label": self.labels[t], "first": first, "last": last, "cover": cover}
                for t, first, last, cover in sorted(covering, key=lambda s: (s[1], s[2], s[0]))
            ],
        }


RESULT = (
    "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, "
    "labels: string, score: double, spans: array<struct<label: string, first: bigint, last: bigint, cover: double>>>"
)
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))]
)


def scan_licences(
    files: DataFrame, text: str = "text", keep: list[str] | None = None, templates=TEMPLATES, phrases=PHRASES, **limits
) -> DataFrame:
    """The columns `keep` of `files` (all but the text) and a struct `licences` for each row.

    Words are runs of digits, letters and what is beyond ASCII, A-Z in lower case. n_base counts all
    places where a phrase's words stand one after the other, first_word and last_word the smallest
    and largest start of these (null without one), base_labels their labels. labels adds those of
    templates covered to `min_cover` by a chain of matches of at least `min_match` words, where foreign words
    inside the chain count against it, and of chains that share words of the text the best covered one's label;
    `spans` has the words each chain runs over. score is the largest cover of any template, 1 with a phrase.

    A null text is empty: no words, no labels, score 0. Each row stands for itself. A column
    `licences` is replaced.
    """
    small_batches(files.sparkSession)
    table = Masked(files, replaced=("licences",))
    table.kept = [i for i in table.kept if table.names[i] != text and (keep is None or table.names[i] in keep)]
    shared = files.sparkSession.sparkContext.broadcast(Scanner(templates, phrases, **limits))

    def run(batches):
        scanner = shared.value
        for batch in batches:
            found = []
            for _, data, ends in slices(batch[-1]):
                w = words(data, ends, ALNUM)
                numbers = scanner.numbers(w.hashes)
                found += [scanner.report(w, numbers, doc) for doc in range(len(ends))]
            yield pa.RecordBatch.from_arrays(
                [*(batch[i] for i in range(len(names))), pa.array(found, _ARROW)], [*names, "__licences"]
            )

    names = table.columns()
    plain = table.df.select(*names, F.col(table.at(text)).cast("string").alias("__text"))
    found = plain.mapInArrow(run, table.fields(f"__licences {RESULT}"))
    return table.back(found, F.col("__licences").alias("licences"))
