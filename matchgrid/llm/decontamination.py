"""Benchmark decontamination by q-gram lemma filtering.

A document is contaminated by a benchmark item if some region of it is within
``ERROR_RATE`` edits per character of the whole item (texts lower-cased, white
space folded). By the q-gram lemma such a region shares at least
n - q + 1 - k * q character q-grams with an item of n characters, k edits
allowed, and all of them on diagonals at most k apart. Shared q-grams are
counted in diagonal bands of a fixed width over k, each with its upper
neighbour, so that the overlapping pairs hold every region; the pairs that meet
the bound are verified by a banded semi-global alignment.

The benchmark's q-gram index travels to the executors. Its size is checked:
items are indexed in blocks of at most ``BLOCK_CHARS`` characters, and the
documents are read once for each block. Where there are several, a block's
results are written before the next index is made, so that the driver holds
one at a time.

Edge cases: a text of any length is searched whole; a null or empty document
matches nothing; an item that is null or
has no character but white space matches nothing; an item shorter than q must
occur exactly. Repeated items are all reported; repeated rows are reported
each. Regions of equal distance: the one that ends first. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, picked

Q = 8
ERROR_RATE = 0.06
#: Characters of the items of one index, at most, but for a single longer item.
BLOCK_CHARS = 4_000_000
MAP_BITS = 22

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = re.compile(r"\s+")


def normalize(text: str | None) -> str:
    return SPACE.sub(" ", text or "").strip().lower()


def grams(text: str) -> np.ndarray:
    """A 64-bit hash of every q-gram of a text."""
    h = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    if len(h) < Q:
        return np.empty(0, np.uint64)
    power, span = int(BASE), 1
    while span < Q:  # Q is a power of two
        h = h[:-span] * np.uint64(power) + h[span:]
        power, span = power * power % 2**64, 2 * span
    return (h ^ (h >> np.uint64(31))) * BASE


def budget(n: int) -> int:
    """Edits allowed for an item of n characters, so that the lemma's bound is positive."""
    return max(0, min(int(ERROR_RATE * n), (n - Q) // Q))


class Index:
    """q-grams of the items with their postings, and a bitmap to pass over the rest."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, normalize(t)) for i, t in items]
        self.short = [(i, t) for i, t in texts if 0 < len(t) < Q]
        kept = [(i, t) for i, t in texts if len(t) >= Q]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(len(t)) for t in self.texts], np.int64)
        self.need = self.size - Q + 1 - self.edits * Q
        self.width = int(self.edits.max(initial=0)) + 1
        self.pad = int(self.size.max(initial=0)) + 1
        hashes = [grams(t) for t in self.texts]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(x) for x in hashes])
        pos = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.item, self.pos = item[order], pos[order]
        self.bitmap = np.zeros(1 << MAP_BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - MAP_BITS)).astype(np.int64)] = True

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of each band pair that meets the lemma's bound."""
        h = grams(text)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - MAP_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return []
        where = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[where] == h[at]
        at, where = at[hit], where[hit]
        n = self.count[where]
        if n.sum() < self.need.min():
            return []
        total = int(n.sum())
        posting = np.repeat(self.first[where] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        item = self.item[posting]
        band = (np.repeat(at, n) - self.pos[posting] + self.pad) // self.width
        bands = (len(text) + self.pad) // self.width + 2
        key, shared = np.unique(item * bands + band, return_counts=True)
        after = np.zeros_like(shared)
        after[:-1] = np.where(key[1:] == key[:-1] + 1, shared[1:], 0)
        # Also the pair whose lower band is empty, below the first of a run.
        good = shared + after >= self.need[key // bands]
        return [(int(k // bands), int(k % bands) * self.width - self.pad) for k in key[good]]


def align(item: str, text: str, low: int, high: int) -> tuple[int, int, int] | None:
    """Least edits of the whole item in a region that starts at diagonals low..high.

    Rows are item characters, columns diagonals; a region may begin and end
    anywhere in the band. Returns (edits, start, end), start being the first
    possible for the region that ends first.
    """
    n, width = len(item), high - low + 1
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    pat = np.frombuffer(item.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    padded = np.full(len(codes) + n + width + abs(low) + 2, -1, np.int64)
    shift = max(0, -low)
    padded[shift : shift + len(codes)] = codes
    far = 1 << 20
    diag = np.arange(low, high + 1)
    row = np.where((diag >= 0) & (diag <= len(codes)), 0, far)
    begin = diag.copy()
    for i in range(n):
        # Cell (i + 1, d) is text position i + 1 + d.
        cell = row + (padded[shift + low + i : shift + low + i + width] != pat[i])
        start = begin
        up = np.append(row[1:] + 1, far)  # item character without a text character
        start = np.where(up < cell, np.append(begin[1:], 0), start)
        cell = np.minimum(cell, up)
        # Text characters without item characters run to higher diagonals.
        best = np.minimum.accumulate(cell - diag)
        source = np.maximum.accumulate(np.where(cell - diag == best, np.arange(width), 0))
        row, begin = best + diag, start[source]
        end = diag + i + 1
        row = np.where((end < 0) | (end > len(codes)), far, row)
    k = int(np.argmin(row))
    return (int(row[k]), int(begin[k]), int(diag[k] + n)) if row[k] < far else None


def regions(index: Index, text: str) -> dict[int, tuple[int, int, int]]:
    """Best (edits, start, end) of each item within its budget, by item position."""
    found: dict[int, tuple[int, int, int]] = {}
    for item, low in index.candidates(text):
        if found.get(item, (1,))[0] == 0:
            continue
        edits = int(index.edits[item])
        exact = text.find(index.texts[item])
        if exact >= 0:
            found[item] = (0, exact, exact + len(index.texts[item]))
            continue
        got = align(index.texts[item], text, low - edits, low + 2 * index.width + edits)
        if got and got[0] <= edits and (item not in found or got < found[item]):
            found[item] = got
    return found


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[Index]]:
    """Number of blocks, and their indexes one after the other, each of bounded size."""
    items = picked(benchmark, item_id="long", text="string").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))

    def indexes() -> Iterator[Index]:
        for k in range(n):
            rows = items.where(part == k).collect()
            yield Index(sorted((-1 if r.item_id is None else r.item_id, r.text) for r in rows))

    return n, indexes()


def decontamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, edits, start, length``: the best region of each item found.

    Offsets are in the normalized text.
    """
    out = None
    n, indexes = _blocks(benchmark, block_chars)
    for index in indexes:
        found = map_arrow(
            picked(docs, doc_id="long", text="string"),
            _scanner(index),
            "doc_id long, item_id long, edits int, start long, length long",
        )
        if n > 1:
            found = materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out


def _scanner(index: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                text = normalize(raw)
                for item, (edits, start, end) in sorted(regions(index, text).items()):
                    out.append((doc_id, index.ids[item], edits, start, end - start))
                for item_id, short in index.short:
                    if (at := text.find(short)) >= 0:
                        out.append((doc_id, item_id, 0, at, len(short)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "item_id", "edits", "start", "length"],
            )

    return scan


def _holds(index: Index, raw: str | None) -> bool:
    text = normalize(raw)
    return bool(regions(index, text)) or any(s in text for _, s in index.short)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item; columns as they came.

    The verdict depends on the text alone. With one block it is applied in the
    pass that reads the rows, without a join; with several, by the hashes of
    the texts that any block found.
    """
    n, indexes = _blocks(benchmark, block_chars)
    if n == 1:
        index = next(indexes)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not _holds(index, t) for t in b.column("text").to_pylist()], pa.bool_()))

        return map_arrow(docs, keep, docs.schema)
    texts, leaks = docs.select(F.xxhash64("text").alias("h"), "text"), None
    for index in indexes:

        def leaking(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = b.filter(pa.array([_holds(index, t) for t in b.column("text").to_pylist()], pa.bool_()))
                yield found.select(["h"])

        part = materialize(map_arrow(texts, leaking, "h long").distinct(), "leaks")
        leaks = part if leaks is None else leaks.unionByName(part)
    return docs.join(leaks.distinct(), F.xxhash64(docs["text"]) == leaks["h"], "left_anti")


