"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and white space folded; their n-grams of one to four
characters, hashed into 2**18 slots, are the features, weighted by
(1 + ln tf) * idf and scaled to unit length. The document frequencies are
counted over all training rows with partial sums in every task. The regression
is trained with the follow-the-regularised-leader rule, whose proximal step
holds an L1 and an L2 penalty (elastic net), so that most weights are exactly
zero; then a temperature is fitted on sample rows that training did not see,
so that the score is a probability.

The regression sees at most ``SAMPLE_ROWS`` training rows, chosen by hash, as
many of each language; the shares of the languages among all training rows are
put back into the probabilities afterwards.

Only text and lang of rows whose crc32(doc_id as text) mod 4 is not 2 are
learned from; a prediction depends on the text alone. The settings were chosen
by cross-validation within these rows.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text if there is nothing to learn from. Rows without lang or
doc_id are not learned from; repeated ones are predicted each, and a doc_id is
in the sample once. Equal probabilities give the language that sorts first. A
text of any length is read whole. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, picked

ORDERS = 4
SLOT_BITS = 18
#: Training rows that the regression and its temperature are fitted on, at most.
SAMPLE_ROWS = 3_000
#: One sample row in so many is for the temperature.
CALIBRATE = 5
EPOCHS = 3
#: Step size and its offset, and the penalties of the FTRL rule.
ALPHA, BETA, L1, L2 = 10.0, 0.1, 0.02, 0.01
FOLDS, HELD = 4, 2
NO_LANGUAGE = "und"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = re.compile(r"\s+")
LETTER = re.compile(r"[^\W\d_]")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of a text, ascending, and how often each occurs."""
    folded = " " + SPACE.sub(" ", text or "").strip().lower() + " "
    codes = np.frombuffer(folded.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    h, out = np.zeros(len(codes) + 1, np.uint64), []
    for n in range(1, min(ORDERS, len(codes)) + 1):
        h = h[:-1] * MULTIPLIER + codes[n - 1 :]
        mixed = (h ^ (h >> np.uint64(29))) * MULTIPLIER
        out.append((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
    slots = np.sort(np.concatenate(out))
    first = np.flatnonzero(np.diff(slots, prepend=-1))
    return slots[first], np.diff(first, append=len(slots)).astype(np.int32)


def tf_idf(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots that training rows have, and their weights, of unit length."""
    value = idf[slots]
    known = value > 0
    value = value[known] * (1 + np.log(counts[known]))
    return slots[known], value / max(1e-12, float(np.sqrt(value @ value)))


def learnable(docs: DataFrame) -> DataFrame:
    rows = picked(docs, doc_id="long", text="string", lang="string")
    return rows.where("lang is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Training rows that have each slot, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << SLOT_BITS) + 1, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                n[features(text)[0]] += 1
            n[-1] += b.num_rows
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(n[slots])], ["slot", "n"])

    # At most 2**18 + 1 rows, whatever the corpus.
    counts = map_arrow(train.select("text"), count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << SLOT_BITS) + 1, np.int64)
    df[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return df[:-1], int(df[-1])


class Row(NamedTuple):
    slots: np.ndarray
    values: np.ndarray
    label: int


def sample_rows(train: DataFrame, languages: list[str], idf: np.ndarray) -> list[Row]:
    """As many rows of each language, ``SAMPLE_ROWS`` at most, in an order given by hashes."""
    each = max(1, SAMPLE_ROWS // len(languages))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    # Each task keeps ``each`` ids of a language before any of them move.
    ids = train.select("lang", "doc_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)
    chosen = train.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column("text").to_pylist()]
            cols = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *cols], ["doc_id", "lang", "slots", "counts"])

    schema = "doc_id long, lang string, slots binary, counts binary"
    rows = map_arrow(chosen.select("doc_id", "lang", "text"), bags, schema)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "slots", "counts")).alias("row"))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").select("row.*").toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    out = []
    for lang, slots, counts in zip(*(rows.column(c).to_pylist() for c in ("lang", "slots", "counts")), strict=True):
        out.append(Row(*tf_idf(np.frombuffer(slots, np.int32), np.frombuffer(counts, np.int32), idf), place[lang]))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def proximal(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that FTRL's sums stand for."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train_ftrl(rows: list[Row], n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each slot and class, and the intercepts."""
    z, n = (np.zeros(((1 << SLOT_BITS) + 1, n_classes)) for _ in range(2))
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            slots = np.append(rows[k].slots, 1 << SLOT_BITS)
            x = np.append(rows[k].values, 1.0)
            zs, ns = z[slots], n[slots]
            w = proximal(zs, ns)
            miss = softmax(x @ w)
            miss[rows[k].label] -= 1
            g = x[:, None] * miss
            more = ns + g * g
            z[slots] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[slots] = more
    w = proximal(z, n)
    return w[:-1].astype(np.float32), w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> float:
    """The temperature of least log loss; ``ratio`` is a class's share of all rows over that in the sample.

    Targets are smoothed by one row's worth, so that rows that are all told
    right do not make every probability one.
    """
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    target[np.arange(n), labels] = 1 - 1 / (n + 2) if k > 1 else 1.0
    weight = (ratio[labels] / ratio[labels].sum())[:, None]

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t) + np.log(ratio))
        return float(-(weight * target * np.log(np.maximum(p, 1e-15))).sum())

    return float(np.exp(min(np.linspace(-4, 3, 141), key=loss)))


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    #: Slots that have a weight, ascending, and their weights by language.
    slots: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float
    ratio: np.ndarray


def fit(docs: DataFrame) -> Model | None:
    train = learnable(docs)
    shares = train.groupBy("lang").count().orderBy("lang").collect()
    if not shares:
        return None
    languages = [r.lang for r in shares]
    df, n = document_frequencies(train)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
    rows = sample_rows(train, languages, idf)
    fitted = [r for k, r in enumerate(rows) if k % CALIBRATE] or rows
    w, intercept = train_ftrl(fitted, len(languages))
    sampled = np.maximum(1, np.bincount([r.label for r in rows], minlength=len(languages)))
    ratio = np.array([r["count"] for r in shares]) / sampled
    ratio = ratio / (ratio @ sampled) * sampled.sum()
    unseen = [r for k, r in enumerate(rows) if k % CALIBRATE == 0]
    logits = np.array([r.values @ w[r.slots] for r in unseen]) + intercept
    temperature = fit_temperature(logits, np.array([r.label for r in unseen]), ratio)
    slots = np.flatnonzero(w.any(axis=1)).astype(np.int32)
    return Model(languages, idf, slots, w[slots], intercept, temperature, ratio)


def predict(model: Model, text: str | None, place: np.ndarray) -> tuple[str, float]:
    """Language and its probability; ``place`` is each slot's row of the weights or -1."""
    if not text or not LETTER.search(text):
        return NO_LANGUAGE, 0.0
    slots, values = tf_idf(*features(text), model.idf)
    at = place[slots]
    held = at >= 0
    p = softmax((values[held] @ model.weights[at[held]] + model.intercept) / model.temperature + np.log(model.ratio))
    k = int(np.argmax(p))
    return model.languages[k], float(p[k])


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    model = fit(docs)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << SLOT_BITS, -1, np.int32)
        if model is not None:
            place[model.slots] = np.arange(len(model.slots))
        for b in batches:
            texts = b.column("text").to_pylist()
            told = [(NO_LANGUAGE, 0.0) if model is None else predict(model, t, place) for t in texts]
            cols = [pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "lang_pred", "score"])

    told = map_arrow(picked(docs, doc_id="long", text="string"), tell, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    return told.select("doc_id", held.alias("held_out"), "lang_pred", "score")
