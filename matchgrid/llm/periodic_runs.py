"""Periodic runs of words by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) of at least ``MIN_LENGTH`` words and ``MIN_EXPONENT`` periods that
no neighbouring word extends. All windows of 2**k words get a name, equal for
equal windows of one document: a name is that of the pair of names half as
long. A window that occurs once in its document has no name, and neither have
those that hold it, so that in plain prose few names are left after four words.

A run of period q covers a multiple g of q behind which at least 2 q + 1 words
equal those q places on; so the candidates of a period are the grid points g
whose longest named window of at most 2 q + 1 words equals that at g + q. A
candidate is extended to either side by the longest common extension, read off
the names by descending powers of two. Of several periods with one stretch the
smallest counts. Everything is done on arrays of many documents at once.

``periodic_runs`` returns the runs and the text without repetitions: a word is
dropped if any run contains it after that run's first q words.

Edge cases: a null or empty text, or one without words, has no run and the
empty text. Repeated rows are answered each. A text of any length is taken
whole; arrays hold 4 bytes a word for each level that has names. Runs come by
start, then period; two runs never share both. An empty table gives an empty
result. Extra columns are ignored; a null doc_id is passed on.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, picked, utf8

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words of documents that are looked at together, about; a longer document is alone.
TOGETHER = 250_000
#: Grid points that are compared at once, about.
GRID = 1 << 20


def named(first: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words from each place; -1 for those that occur once."""
    levels, name, step = [], np.where(np.bincount(first)[first] > 1, first, -1) if len(first) else first, 1
    while (name >= 0).any():
        levels.append(name.astype(np.int32))
        both = np.flatnonzero((name[:-step] >= 0) & (name[step:] >= 0))
        pair = name[both].astype(np.int64) * (int(name.max()) + 1) + name[both + step]
        _, own, n = np.unique(pair, return_inverse=True, return_counts=True)
        often = n[own] > 1
        name = np.full(len(first), -1, np.int64)
        name[both[often]] = own[often]
        step *= 2
    return levels


def extension(levels: list[np.ndarray], at: np.ndarray, q: np.ndarray, back: bool = False) -> np.ndarray:
    """Words from ``at`` on (or before it) that equal those ``q`` places on."""
    n, out = len(levels[0]), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        here = at - out - (1 << k) if back else at + out
        fits = (here >= 0) & (here + q + (1 << k) <= n)
        a = np.where(fits, here, 0)
        name = levels[k][a]
        out += (fits & (name >= 0) & (name == levels[k][np.where(fits, here + q, 0)])) * (1 << k)
    return out


def candidates(levels: list[np.ndarray], upto: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and periods that may be in a run; ``upto`` gives the words of documents long enough for a period."""
    for k in range(1, len(levels)):
        # The periods whose window of at most 2 q + 1 words is that of this level.
        periods = np.arange(1 << (k - 1), 1 << k)
        points = upto(periods) // periods
        periods, points = periods[points > 0], points[points > 0]
        part = np.cumsum(points) // GRID
        for p in np.unique(part):
            q, n = periods[part == p], points[part == p]
            begin = np.repeat(np.cumsum(n) - n, n)
            q = np.repeat(q, n)
            j = np.arange(len(q)) - begin
            g = q * j
            name, behind = levels[k][g], np.minimum(g + q, len(levels[k]) - 1)
            equal = (name >= 0) & (name == levels[k][behind]) & (g < behind)
            # Of neighbouring grid points of a run the first.
            equal[1:] &= ~(equal[:-1] & (j[1:] > 0))
            yield g[equal], q[equal]


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each document's words."""
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    size = np.array([len(documents[d]) for d in order], np.int64)
    ends = np.cumsum(size)
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    number = count()
    first = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for d, a, e in zip(order, ends - size, ends, strict=True):
        # Each document names its own words.
        own = defaultdict(number.__next__)
        first[a:e] = list(map(own.__getitem__, documents[d]))
    levels = named(first)

    def upto(periods: np.ndarray) -> np.ndarray:
        long = np.searchsorted(-size, -np.maximum(MIN_LENGTH, MIN_EXPONENT * periods), side="right")
        return np.concatenate([[0], ends])[long]

    found = [np.empty((0, 3), np.int64)]
    for g, q in candidates(levels, upto):
        start = g - extension(levels, g, q, back=True)
        length = g + q + extension(levels, g, q) - start
        keep = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
        found.append(np.stack([start[keep], length[keep], q[keep]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[smallest]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    place = np.searchsorted(ends, runs[:, 0], side="right")
    for p, (start, length, q) in zip(place.tolist(), runs.tolist(), strict=True):
        out[order[p]].append((start - int(ends[p] - size[p]), length, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those behind the first period of a run, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist())


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's planted runs: of one document in ten by hash, the words from some place on repeat."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, runs, text`` of every row; ``prepare`` may change a document's words first."""

    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(RUN)),
                pa.array([collapsed(w, r).decode() for w, r in zip(texts, runs, strict=True)], pa.string()),
            ],
            ["doc_id", "runs", "text"],
        )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, n = [], [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = utf8(text).split()
                if prepare is not None:
                    words = prepare(doc_id, words)
                if texts and n + len(words) > TOGETHER:
                    yield answer(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                n += len(words)
            yield answer(ids, texts)

    return map_arrow(picked(docs, doc_id="long", text="string"), find, SCHEMA)


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and digests of all runs and of the collapsed text."""
    # Greatest length, then smallest start, then smallest period.
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), listed.alias("listed"), "text")
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
