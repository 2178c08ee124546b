"""License scans: exact set-similarity join of text blocks with templates.

A text block is a line of a document, as a set of words, or a window of words
across line breaks, a quarter longer than the template at the usual threshold,
so that wrapped notices are found; a template is the word set of a licence
statement. A block matches if it holds at least
``MIN_CONTAINMENT`` of a template's words. The join is exact: all words are put
into one global order, rarest first, by the number of documents of the corpus
that hold them (a pass over all rows, with partial counts). A block can only
match a template if one of the block's prefix words (all but the required
overlap less one) is among the template's prefix words, if it is long enough
for the required overlap, and if the words left behind the shared position can
still make up that overlap; what passes is verified by the overlap itself. Every
template found gives its label; only a variant is left out, of which the block
holds no word that a more fully held template does not explain (cc-by-nc where
cc-by-sa stands). The template list is fixed, so its index travels with the plan.

Besides the templates, base phrases are found wherever their words stand
consecutively in the whole text.

Edge cases: ties between templates, or between windows, of one label give that
label once, with the same score. A null or empty text has no words, no labels and score 0. Repeated
rows are scanned each on its own. Very long lines are blocks like any other.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, picked, utf8

MIN_CONTAINMENT = 0.8

#: Phrases of the contract and their labels.
BASE = ((b"cc by", "cc-by"), (b"general public license", "gpl"), (b"all rights reserved", "reserved"))

#: Short licence statements, by label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Lower-cases A-Z and turns every byte outside words, but the line feed, into a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
VOCABULARY = frozenset(w for _, t in TEMPLATES for w in t.encode().translate(FOLD).split())


def word_rows(docs: DataFrame) -> dict[bytes, int]:
    """Documents of the corpus that hold each template word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = dict.fromkeys(VOCABULARY, 0)
        for b in batches:
            for text in b.column("text").to_pylist():
                for w in VOCABULARY.intersection(utf8(text).translate(FOLD).split()):
                    n[w] += 1
        words = sorted(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([n[w] for w in words], pa.int64())], ["word", "n"]
        )

    found = map_arrow(picked(docs, text="string"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # One row per word of the fixed template list.
    return {bytes(r.word): r.n for r in found.collect()}


class Join:
    """Prefix, length and positional filters over the template index."""

    def __init__(self, rows: dict[bytes, int], threshold: float = MIN_CONTAINMENT):
        order = sorted(VOCABULARY, key=lambda w: (rows.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates: list[tuple[str, frozenset[int], int]] = []
        #: Words of a window for each template.
        self.spans: list[int] = []
        self.index: dict[int, list[tuple[int, int]]] = {}
        for n, (label, text) in enumerate(TEMPLATES):
            words = sorted({self.rank[w] for w in text.encode().translate(FOLD).split()})
            need = ceil(threshold * len(words) - 1e-9)
            self.templates.append((label, frozenset(words), need))
            self.spans.append(ceil(len(text.encode().translate(FOLD).split()) / threshold - 1e-9))
            for pos, w in enumerate(words[: len(words) - need + 1]):
                self.index.setdefault(w, []).append((n, pos))
        self.least = min(need for *_, need in self.templates)
        self.prefix_words = frozenset(order[w] for w in self.index)

    def contained(self, block: list[bytes]) -> dict[int, frozenset[int]]:
        """The templates that meet the threshold, with the words that the block holds of each."""
        rank = self.rank
        words = sorted({rank[w] for w in block if w in rank})
        if len(words) < self.least:
            return {}
        out, tried, members = {}, set(), set(words)
        for pos, w in enumerate(words[: len(words) - self.least + 1]):
            for n, at in self.index.get(w, ()):
                if n in tried:
                    continue
                _, template, need = self.templates[n]
                if len(words) < need or pos > len(words) - need:
                    continue
                tried.add(n)
                # Nothing before this pair is shared, as it would have met first.
                if 1 + min(len(words) - pos, len(template) - at) - 1 < need:
                    continue
                shared = template & members
                if len(shared) >= need:
                    out[n] = shared
        return out

    def share(self, n: int, shared: frozenset[int]) -> float:
        return len(shared) / len(self.templates[n][1])

    def explained(self, n: int, shared: frozenset[int], m: int, other: frozenset[int]) -> bool:
        """Whether n is but a variant of m: m is held more fully and has all words that are held of n."""
        return self.share(m, other) > self.share(n, shared) and shared <= other

    def matches(self, block: list[bytes]) -> list[tuple[str, float]]:
        """All templates that meet the threshold, but for mere variants of a fuller one."""
        found = self.contained(block)
        return [
            (self.templates[n][0], self.share(n, shared))
            for n, shared in found.items()
            if not any(self.explained(n, shared, m, other) for m, other in found.items())
        ]


    def windows(self, n: int, places: list[tuple[int, int]]) -> list[tuple[int, int, frozenset[int]]]:
        """First and last place and words held of template n, of the windows that meet the threshold.

        ``places`` are the places and ranks of a text's template words, in text order. One
        window ends at each word of the template, so both ends never go back.
        """
        _, template, need = self.templates[n]
        mine = [(i, w) for i, w in places if w in template]
        out, held, a = [], Counter(), 0
        for i, w in mine:
            held[w] += 1
            while i - mine[a][0] >= self.spans[n]:
                old = mine[a][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                a += 1
            if len(held) >= need:
                out.append((mine[a][0], i, frozenset(held)))
        return out

    def wrapped(self, lines: list[list[bytes]]) -> list[tuple[str, float]]:
        """The templates that windows across line breaks hold, but for mere variants of a fuller one."""
        rank, places, line_of = self.rank, [], []
        for k, line in enumerate(lines):
            places += [(len(line_of) + i, rank[w]) for i, w in enumerate(line) if w in rank]
            line_of += [k] * len(line)
        present = {w for _, w in places}
        found = {
            n: self.windows(n, places)
            for n, (_, template, need) in enumerate(self.templates)
            if len(template & present) >= need
        }
        ends = {n: [w[1] for w in ws] for n, ws in found.items()}
        out = []
        for n, ws in found.items():
            tried, best = set(), 0.0
            for lo, hi, shared in ws:
                # Windows of one line are part of that line's block.
                if line_of[lo] == line_of[hi] or (lo, shared) in tried:
                    continue
                tried.add((lo, shared))
                if self.share(n, shared) > best and not any(
                    self.explained(n, shared, m, other)
                    for m in found
                    if m != n
                    for _, _, other in _around(found[m], ends[m], lo, hi)
                ):
                    best = self.share(n, shared)
            if best:
                out.append((self.templates[n][0], best))
        return out


def _around(ws: list[tuple[int, int, frozenset[int]]], ends: list[int], lo: int, hi: int) -> Iterator[tuple[int, int, frozenset[int]]]:
    """The windows that reach over [lo, hi]."""
    for k in range(bisect_left(ends, hi), len(ws)):
        if ws[k][0] > lo:
            break
        yield ws[k]


def base_places(words: list[bytes], present: set[bytes]) -> tuple[list[int], set[str]]:
    """Starts and labels of the base phrases in a text's words."""
    starts, labels = [], set()
    for phrase, label in BASE:
        parts = phrase.split()
        if not present.issuperset(parts):
            continue
        first, at = parts[0], -1
        while True:
            try:
                at = words.index(first, at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                starts.append(at)
                labels.add(label)
    return starts, labels


ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64())]
    + [("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def license_scan(docs: DataFrame, threshold: float = MIN_CONTAINMENT) -> DataFrame:
    """Base phrases, template labels and the best containment of every document."""
    join = Join(word_rows(docs), threshold)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                folded = utf8(text).translate(FOLD)
                words = folded.split()
                present = VOCABULARY.intersection(words)
                starts, base = base_places(words, present) if present else ([], set())
                labels, score = set(base), 1.0 if base else 0.0
                if not present.isdisjoint(join.prefix_words):
                    lines = [line.split() for line in folded.split(b"\n")]
                    found = [m for line in lines for m in join.matches(line)]
                    if len(lines) > 1:
                        found += join.wrapped(lines)
                    for label, share in found:
                        labels.add(label)
                        score = max(score, share)
                out.append(
                    (doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None))
                    + (",".join(sorted(base)), ",".join(sorted(labels)), score)
                )
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, ARROW.field(i).type) for i, c in enumerate(cols)], schema=ARROW
            )

    return map_arrow(
        picked(docs, doc_id="long", text="string"),
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double",
    )
