"""Toxicity: a character n-gram linear classifier with naive Bayes features.

Texts are lower-cased and white space folded; the distinct character n-grams of
three to six characters, and those of seven to eleven that begin a word and do
not go beyond its end, hashed into 2**20 slots, are the features. Each is
scaled by its naive Bayes log-count ratio, counted over all training rows with
partial sums in every task, and a logistic regression on the scaled features is
fitted on a bounded, documented sample (``SAMPLE_PER_CLASS`` training rows of
each class, chosen by hash). Features seen in too few training rows, or whose
ratio is small or not clear of its own standard error, have ratio zero and cost
nothing; ratios for either class are kept with their sign.

The settings were chosen by cross-validation within the rows that may be
learned from; the held-out rows were not looked at.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0;
the score depends on the text alone.

Edge cases: a null or empty text is scored by the intercept, and a text of any
length as a whole. A score of exactly one half counts as toxic. Of rows with equal
hashes the one of the smaller id is in the sample. Repeated rows are
scored each on its own; a repeated label counts once, and as toxic if one of
its rows says so. Without training rows of both classes, or without a feature that is
clear of its error, nothing can be told apart and every score is next to 0. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, picked

ORDERS = (3, 4, 5, 6)
#: Longest n-gram from the space before a word.
WORD_ORDER = 11
SLOT_BITS = 20
#: Training rows of each class that the regression is fitted on, at most.
SAMPLE_PER_CLASS = 3000
#: Training rows that must hold a feature before it counts.
MIN_ROWS = 5
#: Added to the count of either class.
SMOOTHING = 1.0
#: Ratios of fewer standard errors, or smaller ones, are taken as zero.
MIN_ERRORS = 3.0
MIN_RATIO = 0.5
#: Features of training rows that the fit looks at together; bounds its memory.
FIT_FEATURES = 1 << 20
FOLDS = 5
#: Labels (12 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = re.compile(r"\s+")


def slots_of(text: str | None) -> np.ndarray:
    """Feature slots of a text's n-grams, with repeats."""
    folded = " " + SPACE.sub(" ", text or "").strip().lower() + " "
    codes = np.frombuffer(folded.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    h, out = codes.copy(), []

    def mark(hashes: np.ndarray) -> None:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * MULTIPLIER
        out.append((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64))

    for n in range(2, ORDERS[-1] + 1):
        if len(codes) < n:
            break
        h = h[:-1] * MULTIPLIER + codes[n - 1 :]
        if n in ORDERS:
            mark(h)
    # Longer ones from the space before each word, as far as the word goes.
    gaps = np.flatnonzero(codes == 32)
    room = np.diff(gaps)
    at = gaps[:-1][room >= ORDERS[-1]]
    room = room[room >= ORDERS[-1]]
    if len(at):
        h = h[at]
        for n in range(ORDERS[-1] + 1, WORD_ORDER + 1):
            long = room >= n - 1
            at, room, h = at[long], room[long], h[long]
            if not len(at):
                break
            h = h * MULTIPLIER + codes[at + n - 1]
            mark(h)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Distinct feature slots; ``seen`` is a cleared Boolean scratch array."""
    seen[slots_of(text)] = True
    # Eight flags at a time find the few slots that are set.
    words = np.flatnonzero(seen.view(np.uint64))
    rows, cols = np.nonzero(seen.reshape(-1, 8)[words])
    found = words[rows] * 8 + cols
    seen[found] = False
    return found


def features_in(text: str | None, kept: np.ndarray) -> np.ndarray:
    """Distinct feature slots of those that are ``kept``, a Boolean array."""
    slots = slots_of(text)
    return np.unique(slots[kept[slots]])


def scratch() -> np.ndarray:
    return np.zeros(1 << SLOT_BITS, dtype=bool)


def _table(used: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots that have a weight, and the weights."""
    kept, table = scratch(), np.zeros(1 << SLOT_BITS, np.float32)
    kept[used], table[used] = True, values
    return kept, table


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of the rows that may be learned from."""
    lab = picked(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)")
    lab = lab.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    lab = materialize(lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    # While the labels are few, the texts need not move to meet them.
    if lab.count() <= BROADCAST_LABELS:
        lab = F.broadcast(lab)
    return picked(docs, doc_id="long", text="string").join(lab, "doc_id")


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, tuple[int, int]]:
    """Ratio of each slot over all training rows, and the rows of each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = scratch(), np.zeros((2, (1 << SLOT_BITS) + 1), np.int32)
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                n[toxic][features(text, seen)] += 1
                n[toxic][-1] += 1
        slots = np.flatnonzero(n.any(axis=0))
        for k in range(0, len(slots), 50_000):
            s = slots[k : k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.astype(np.int32)), pa.array(n[0][s]), pa.array(n[1][s])], ["slot", "clean", "toxic"]
            )

    counts = map_arrow(train.select("text", "toxic"), count, "slot int, clean int, toxic int")
    counts = counts.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counts.where(F.col("slot") == 1 << SLOT_BITS).first()
    rows = (int(total["clean"]), int(total["toxic"])) if total else (0, 0)
    ratio = np.zeros(1 << SLOT_BITS, np.float32)
    if min(rows) == 0:
        return ratio, rows
    c0, c1 = F.col("clean") + SMOOTHING, F.col("toxic") + SMOOTHING
    value = F.log(c1 / (rows[1] + SMOOTHING)) - F.log(c0 / (rows[0] + SMOOTHING))
    # At most 2**20 slots, whatever the corpus.
    kept = (
        counts.where((F.col("slot") < 1 << SLOT_BITS) & (F.col("clean") + F.col("toxic") >= MIN_ROWS))
        .where((F.abs(value) >= MIN_ERRORS * F.sqrt(1 / c0 + 1 / c1)) & (F.abs(value) >= MIN_RATIO))
        .select("slot", value.cast("float").alias("r"))
        .toArrow()
    )
    ratio[kept.column("slot").to_numpy()] = kept.column("r").to_numpy()
    return ratio, rows


def fit_regression(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = 150, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence features, by Adam."""
    ends = np.cumsum([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int32) if len(rows) and ends[-1] else np.empty(0, np.int32)
    slots = np.unique(flat)
    place = np.zeros(len(ratio), np.int32)
    place[slots] = np.arange(len(slots), dtype=np.int32)
    flat = place[flat]
    # Blocks of whole rows.
    cuts = [0, *(np.flatnonzero(np.diff(ends // FIT_FEATURES)) + 1).tolist(), len(rows)]
    blocks = [(a, b, flat[ends[a - 1] if a else 0 : ends[b - 1]], np.diff(ends[a:b], prepend=ends[a - 1] if a else 0)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
    x = ratio[slots].astype(np.float64)
    w, b = np.zeros(len(slots)), 0.0
    m, v = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    for step in range(1, epochs + 1):
        grad, scaled = np.append(l2 * w, 0.0), w * x
        for begin, end, column, sizes in blocks:
            sums = np.concatenate([[0.0], np.cumsum(scaled[column])])
            upto = np.cumsum(sizes)
            z = sums[upto] - sums[upto - sizes] + b
            err = weight[begin:end] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[begin:end]) / len(y)
            grad[:-1] += np.bincount(column, np.repeat(err, sizes), len(slots)) * x
            grad[-1] += err.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        change = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - change[:-1], b - change[-1]
    full = np.zeros(len(ratio), np.float32)
    full[slots] = w * x
    return full, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of each slot (regression weight times ratio) and the intercept."""
    train = training_rows(docs, labels)
    ratio, counts = log_count_ratios(train)
    if min(counts) == 0 or not ratio.any():
        return ratio, -35.0
    ids = None
    for k in (0, 1):
        part = train.where(F.col("toxic") == k).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id")
        part = part.limit(SAMPLE_PER_CLASS)
        ids = part if ids is None else ids.unionByName(part)
    mask = ratio != 0

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features_in(text, mask).astype(np.int32).tobytes() for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(found, pa.binary()), b.column("toxic")], ["doc_id", "slots", "toxic"]
            )

    # At most 2 * SAMPLE_PER_CLASS ids, so the broadcast has a fixed bound.
    chosen = train.join(F.broadcast(ids.distinct()), "doc_id")
    got = map_arrow(chosen.select("doc_id", "text", "toxic"), sample, "doc_id long, slots binary, toxic int")
    got = got.select("slots", "toxic").toArrow().to_pydict()
    got = sorted(zip(got["slots"], got["toxic"], strict=True))
    rows = [np.frombuffer(s, dtype=np.int32) for s, _ in got]
    return fit_regression(rows, np.array([t for _, t in got], dtype=np.float64), ratio)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    weights, bias = fit(docs, labels)
    used = np.flatnonzero(weights).astype(np.int32)
    values = weights[used]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, table = _table(used, values)
        for b in batches:
            z = np.array([float(table[features_in(t, kept)].sum()) + bias for t in b.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    scored = map_arrow(
        picked(docs, doc_id="long", text="string"), score, "doc_id long, score double, predicted int"
    )
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents whose text is not predicted toxic; columns as they came.

    The labels belong to ``learn_from``, which is ``docs`` if not given.

    The verdict depends on the text alone, so it is applied inside the pass
    that scores the rows, without a join.
    """
    weights, bias = fit(docs if learn_from is None else learn_from, labels)
    used = np.flatnonzero(weights).astype(np.int32)
    values = weights[used]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, table = _table(used, values)
        for b in batches:
            z = [float(table[features_in(t, kept)].sum()) + bias for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(np.array(z, dtype=np.float64) < 0))

    return map_arrow(docs, keep, docs.schema)
