"""Suffix-array deduplication by a depth-limited radix sort.

Only the first ``WINDOW`` bytes of each suffix matter, so suffixes are ordered
by most-significant-digit passes down to that depth and no further; the groups
that are still equal there are exactly the repeated windows. A byte goes if a
repeated window covers it.

A pass takes each group of equal suffixes apart by its next digit: the new
group is the hash of the old one and the digit. Suffixes that are alone in
their group are dropped after the pass. So that no pass has to move every
suffix, suffixes of neighbouring starts travel as one run while they share the
digits, and the order of the digits is anchored at a place chosen by content:

* First digit: the 32 bytes at a window's minimizer (the position of the least
  32-byte hash within the window). Equal windows have equal minimizers at equal
  distances, and neighbouring windows share theirs, so one row stands for a run
  of some 85 suffixes.
* Second digit: the bytes on either side that all suffixes of a run share, for
  runs cut to 25 starts, aligned to the minimizer; third and fourth: the bytes
  that more are shared by runs of 5 starts and by single suffixes. After the
  last, all bytes to the depth have been compared.

A run whose whole extent occurs again is repeated and done; one row of such a
class goes on as a witness for the others of its group.

Group sizes are sums of class sizes, made with partial sums; classes learn
their group's size, and rows their class, by joins in which frequent keys are
broadcast, and no group is gathered in a task. Equality is that of 64-bit
hashes, of the digits and of the run's extent, as in any hash partition.

Edge cases: a null or empty text, and one shorter than a window, is kept whole.
Rows that repeat id and text count as separate places, so both are removed.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, map_arrow, materialize, picked, utf8

WINDOW = 200
GRAM = 32
#: Starts of a run after each pass; each divides the one before.
WIDTHS = (25, 5, 1)
#: Starts whose minimizers are found at a time; longer texts take several turns.
CHUNK = 1 << 24

SPAN = WINDOW - GRAM + 1
POS_BITS = np.uint64(28)
POS_MASK = np.uint64((1 << 28) - 1)
BASE = 0x9E3779B97F4A7C15
WORD = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gram_hashes(raw: bytes) -> np.ndarray:
    """A mixed 64-bit hash of every ``GRAM`` bytes."""
    h = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    power, span = BASE, 1
    while span < GRAM:
        h = h[:-span] * np.uint64(power) + h[span:]
        power, span = power * power & WORD, 2 * span
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs(raw: bytes, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digit, minimizer place, least and most distance to it of each run of windows.

    A run holds the windows that start at place - most .. place - least.
    """
    none = np.empty(0, np.int64)
    parts = [(none.astype(np.uint64), none, none, none)]
    for begin in range(0, len(raw) - WINDOW + 1, chunk):
        g = gram_hashes(raw[begin : begin + chunk + WINDOW - 1])
        # Hash above, position below: the least is the leftmost of equal hashes.
        m = (g & ~POS_MASK) | np.arange(len(g), dtype=np.uint64)
        span = 1
        while 2 * span <= SPAN:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < SPAN:
            m = np.minimum(m[: len(m) - (SPAN - span)], m[SPAN - span :])
        place = (m & POS_MASK).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:], [len(place)]]) - 1
        at = place[first]
        parts.append((g[at], at + begin, at - last, at - first))
    if len(parts) == 2:
        return parts[1]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _with_key(docs: DataFrame) -> DataFrame:
    """``dk, doc_id, text``; dk tells rows apart by id and text."""
    named = picked(docs, doc_id="long", text="string")
    return named.select(F.xxhash64("doc_id", "text").alias("dk"), "doc_id", "text")


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        ks, us, dks, ats = [], [], [], []
        for dk, text in zip(b.column("dk").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw = utf8(text)
            k, at, low, high = runs(raw)
            ks.append(k)
            us += [
                digest(raw[p - h : p - w + WINDOW], w << 8 | h)
                for p, w, h in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)
            ]
            dks.append(np.full(len(k), dk, np.int64))
            ats.append(at << 16 | low << 8 | high)
        k = np.concatenate(ks) if ks else np.empty(0, np.uint64)
        cols = [k.view(np.int64), np.array(us, dtype=np.uint64).view(np.int64)]
        cols += [np.concatenate(x) if x else np.empty(0, np.int64) for x in (dks, ats)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k", "u", "dk", "at"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffles."""
    for b in batches:
        pack = zstandard.ZstdCompressor(level=1).compress
        z = [pack(utf8(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("dk"), b.column("doc_id"), pa.array(z, pa.binary())], ["dk", "doc_id", "z"]
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run that goes on, cut out of its document."""
    for b in batches:
        out = []
        unpack = zstandard.ZstdDecompressor().decompress
        for dk, z, found in zip(*(b.column(c).to_pylist() for c in ("dk", "z", "found")), strict=True):
            raw = unpack(z)
            for r in found:
                p, low, high = r["at"] >> 16, r["at"] >> 8 & 255, r["at"] & 255
                out.append((r["k"], dk, r["at"], raw[p - high : p - low + WINDOW]))
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["k", "dk", "at", "bytes"]
        )


def next_digit(raw: bytes, top: int, start: int, width: int, before: tuple[int, int] | None) -> bytes:
    """The bytes shared by all suffixes of a run that its earlier digits do not hold.

    ``top`` is the minimizer's place in ``raw``, ``start`` the least distance of
    the aligned run and ``before`` the same and the width of the run it comes
    from, if not from the first pass.
    """
    known, upto = (top, top + GRAM) if before is None else (top - before[0], top - before[0] + WINDOW - before[1] + 1)
    return raw[top - start : known] + raw[upto : top - start + WINDOW - width + 1]


def _cut(width: int, wider: int | None):
    """Cuts runs to aligned ones of ``width`` starts; each goes to the group of (its group, next digit)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out = []
            for dk, at, raw, ranges in zip(*(b.column(c).to_pylist() for c in ("dk", "at", "bytes", "ranges")), strict=True):
                # raw begins ``top`` bytes before the minimizer.
                place, top = at >> 16, at & 255
                for r in ranges:
                    k, low, high = r["k"], r["r"] >> 8, r["r"] & 255
                    before = None if wider is None else (low // wider * wider, wider)
                    for j in range(low // width, high // width + 1):
                        a, z = max(low, j * width), min(high, j * width + width - 1)
                        digit = digest(next_digit(raw, top, j * width, width, before), (k + j) & WORD)
                        whole = digest(raw[top - z : top - a + WINDOW], a << 8 | z)
                        out.append((_signed(digit), _signed(whole), dk, place << 16 | a << 8 | z, at))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], ["k", "u", "dk", "at", "source"]
            )

    return cut


def _classify(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose group ``k`` has others, with ``repeated`` (so has the whole extent ``u``)
    and ``on`` (the row goes on: undecided, or the witness of a repeated class)."""
    place = F.struct("dk", "at")
    classes = rows.groupBy("k", "u").agg(F.count("*").alias("n"), F.min(place).alias("witness"))
    classes = materialize(classes, f"{name}-classes")
    groups = materialize(classes.groupBy("k").agg(F.sum("n").alias("all")).where("all > 1"), f"{name}-groups")
    known = join_keyed(classes, groups.withColumn("n_rows", F.col("all")), "k").withColumn("n_rows", F.col("n"))
    known = materialize(known, f"{name}-known", instead_of=(classes, groups))
    joined = join_keyed(rows, known, ["k", "u"])
    repeated = F.col("n") > 1
    goes_on = ~repeated | ((F.col("n") < F.col("all")) & (place == F.col("witness")))
    joined = joined.withColumns({"repeated": repeated, "on": goes_on}).drop("n", "all", "witness")
    return materialize(joined, name, instead_of=(rows, known))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``dk, at``: packed minimizer place and distances of all repeated runs."""
    keyed = _with_key(docs)
    every = map_arrow(keyed.select("dk", "text"), _first_pass, "k long, u long, dk long, at long")
    every = materialize(every, "suffix-first")
    groups = every.groupBy("k").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    first = join_keyed(every, materialize(groups, "suffix-groups"), "k")
    first = materialize(first, "suffix-runs", instead_of=(every,))
    rows = _classify(first, "suffix-runs")
    spans = rows.where("repeated").select("dk", "at")
    todo = rows.where("on").groupBy("dk").agg(F.collect_set(F.struct("k", "at")).alias("found"))
    packed = map_arrow(keyed, _packed, "dk long, doc_id long, z binary").select("dk", "z")
    # Rows of equal id and text have equal runs; each counts, so none is dropped.
    contexts = map_arrow(packed.join(todo, "dk"), _contexts, "k long, dk long, at long, bytes binary").distinct()
    contexts = materialize(contexts, "suffix-bytes")
    own = F.array(F.struct("k", F.expr("at & 65535").alias("r")))
    parts, wider = contexts.select("dk", "at", "bytes", own.alias("ranges")), None
    for width in WIDTHS:
        units = map_arrow(parts, _cut(width, wider), "k long, u long, dk long, at long, source long")
        units = _classify(materialize(units, "suffix-cut"), "suffix-units")
        spans = spans.unionByName(units.where("repeated").select("dk", "at"))
        ranges = (
            units.where("on")
            .groupBy("dk", "source")
            .agg(F.collect_list(F.struct("k", F.expr("at & 65535").alias("r"))).alias("ranges"))
            .withColumnRenamed("source", "at")
        )
        parts, wider = contexts.select("dk", "at", "bytes").join(ranges, ["dk", "at"]), width
    return spans


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        unpack = zstandard.ZstdDecompressor().decompress
        out = []
        for doc_id, z, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "z", "found")), strict=True):
            raw = unpack(z)
            kept, removed, n_spans, upto = [], 0, 0, 0
            for a, e in sorted(((x >> 16) - (x & 255), (x >> 16) - (x >> 8 & 255) + WINDOW) for x in found or ()):
                if a > upto or not n_spans:
                    n_spans += 1
                    kept.append(raw[upto:a])
                    removed += e - a
                    upto = e
                elif e > upto:
                    removed += e - upto
                    upto = e
            kept.append(raw[upto:])
            out.append((doc_id, len(raw), removed, n_spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    found = repeated_spans(docs).groupBy("dk").agg(F.collect_set("at").alias("found"))
    packed = map_arrow(_with_key(docs), _packed, "dk long, doc_id long, z binary")
    return map_arrow(
        packed.join(found, "dk", "left").select("doc_id", "z", "found"),
        _finish,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )
