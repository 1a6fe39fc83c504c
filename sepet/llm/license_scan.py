"""License scans: a generalised suffix automaton of licence wordings, matching statistics, chained spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

# Phrases that decide the base labels, and wordings of common licences and notices (public texts).
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
        "not distributed with this file you can obtain one at",
    ],
    "cc-by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}

LEAST_MATCH = 3
#: Words of a document that may lie between two matches of one span.
GAP = 16
#: Share of a wording that a span must cover to give its label.
LEAST_COVER = 0.75
BASE_SCORE = 0.5

# Fixed value of the contract: bytes that belong to words; all others separate them.
_SPLIT = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in bytes(range(256)).lower()
)


def words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(_SPLIT).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the places of every state's strings."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]
        for t, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word)
                self.places[last].append((t, at + 1))
        # A state's strings also end wherever those of the states that link to it end.
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]
        self.places = [sorted(set(p)) for p in self.places]

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # a string of an earlier text
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def matches(self, run: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the longest matches in ``run`` that no next word continues.

        Matching statistics: after each word, the longest end of what was read that is a string of some text.
        """
        state = length = 0
        for at, word in enumerate(run):
            grown = self.next[state].get(word)
            if grown is None:
                if length >= least:
                    yield at, length, state
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                grown = self.next[state].get(word)
            state, length = (0, 0) if grown is None else (grown, length + 1)
        if length >= least:
            yield len(run), length, state


class Scanner:
    """Labels, spans and base places of texts."""

    def __init__(self, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None):
        templates, phrases = templates or TEMPLATES, phrases or PHRASES
        flat = [(label, words(t.encode())) for label, many in templates.items() for t in many]
        self.labels = [label for label, _ in flat]
        self.sizes = [len(w) for _, w in flat]
        self.phrases = {label: words(p.encode()) for label, p in phrases.items()}
        self.number: dict[bytes, int] = {}
        for many in [*(w for _, w in flat), *self.phrases.values()]:
            for w in many:
                self.number.setdefault(w, len(self.number) + 1)
        self.phrases = {k: [self.number[w] for w in v] for k, v in self.phrases.items()}
        self.automaton = Automaton([[self.number[w] for w in many] for _, many in flat])
        self.least = min(LEAST_MATCH, *self.sizes)

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, template words covered) of chained matches, in document order.

        Matches of a template join a chain while they go on in it and at most ``GAP`` other words lie between.
        """
        known = np.concatenate(([False], ids > 0, [False]))
        turns = np.flatnonzero(known[1:] != known[:-1])
        open_: dict[int, list[int]] = {}  # template: [first word, end word, template end, covered]
        done = []
        for first, end in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if end - first < self.least:
                continue
            for at, length, state in self.automaton.matches(ids[first:end].tolist(), self.least):
                stop = first + at
                start = stop - length
                places: dict[int, list[int]] = {}
                for t, to in self.automaton.places[state]:
                    places.setdefault(t, []).append(to)
                for t, ends in places.items():
                    chain = open_.get(t)
                    if chain is not None and start - chain[1] <= GAP:
                        # The first place that ends after what is covered; what overlaps counts once.
                        overlap = max(0, chain[1] - start)
                        to = next((e for e in ends if e > chain[2] and e - length >= chain[2] - overlap), None)
                        if to is not None:
                            chain[3] += min(length, to - chain[2])
                            chain[1], chain[2] = stop, to
                            continue
                    if chain is not None:
                        if chain[3] >= length and start < chain[1]:
                            continue
                        done.append((t, *chain))
                    open_[t] = [start, stop, ends[0], length]
        done += [(t, *chain) for t, chain in open_.items()]
        return sorted((t, a, b, covered) for t, a, b, _, covered in done)

    def scan(self, text: bytes | None) -> dict:
        tokens = words(text)
        get = self.number.get
        ids = np.array([get(w, 0) for w in tokens], np.int32) if tokens else np.zeros(0, np.int32)
        base: dict[str, np.ndarray] = {}
        for label, phrase in self.phrases.items():
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = ids[:n] == phrase[0]
                for k, w in enumerate(phrase[1:], 1):
                    hit &= ids[k : k + n] == w
                if hit.any():
                    base[label] = np.flatnonzero(hit)
        best, spans = 0.0, []
        for t, a, b, covered in self.spans(ids):
            share = covered / self.sizes[t]
            best = max(best, share)
            if share >= LEAST_COVER:
                spans.append({"label": self.labels[t], "first_word": a, "end_word": b, "cover": share})
        starts = np.concatenate(list(base.values())) if base else np.zeros(0, np.int64)
        return {
            "n_words": len(tokens),
            "n_base": len(starts),
            "first_word": int(starts.min()) if base else None,
            "last_word": int(starts.max()) if base else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted({*base, *(s["label"] for s in spans)})),
            "score": min(1.0, max(best, BASE_SCORE if base else 0.0)),
            "spans": spans,
        }


RESULT = pa.schema(
    [
        ("ident", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))),
    ]
)


def scan_licenses(
    df: DataFrame, text: str, ident: str, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None
) -> DataFrame:
    """One row per row of ``df``: number of words, base places and labels, all labels, score and covered spans.

    The automaton's size depends on the wordings alone; it is sent with the task. Each text is read once from
    end to end in time linear in its words, whatever its length. Null and empty texts have no words and no
    labels and score 0; repeated rows give repeated results. Spans cover at least ``LEAST_COVER`` of a wording;
    the score is the largest share of a wording covered, and at least ``BASE_SCORE`` where a phrase stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [{"ident": i, **scanner.scan(t.as_py())} for i, t in zip(ids, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, RESULT)

    schema = (
        "ident bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<label:string,first_word:bigint,end_word:bigint,cover:double>>"
    )
    return df.select(col(ident).cast("bigint").alias("ident"), col(text).cast("binary").alias("t")).mapInArrow(run, schema)
