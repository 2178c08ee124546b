"""Ranked lexical search as a blocked sparse matrix product.

The scores of all items in all documents are the product of two sparse
matrices: how often an item holds a term, and the int64 impact of a term in a
document. The documents are read once and written as rows of the second matrix
(the terms of the benchmark that a document holds, and how often); counts of
the corpus are sums over these rows. The product follows Gustavson: of a block
of documents every entry takes its term's row of the first matrix, scaled, and
the rows are merged by item in a dense accumulator of bounded size. Each block
keeps the best ``k`` documents of an item seen so far, each task returns its
best, and a ranking window reduces these.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is
25 + 75 n N div L, and a term adds w * (1e9 tf div (1000 tf + 8 m)), all in
64-bit integers.

The first matrix travels to the executors. Its size is checked: items are taken
in blocks of at most ``BLOCK_CHARS`` characters, and the documents are read
once for each block; a block's results are written before the next is made.

Edge cases: a null text has no term, as item or document; an item without
terms, or whose terms no document holds, has no row. Repeated documents are
ranked each; a repeated item is answered each time. Equal scores rank by
ascending doc_id, rows without doc_id last. Texts of any length are read
whole; a long one is a longer row of the matrix. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, picked, utf8

TOP = 10
#: Characters of the items of one block, at most, but for a single longer item.
BLOCK_CHARS = 4_000_000
#: Cells of the accumulator, and entries that are expanded at once, about.
CELLS = 1 << 20
#: Candidates that a task holds before it keeps only the best of each item.
HELD = 1 << 17

#: Letters of ASCII in lower case and digits stay, other ASCII separates, the rest stays.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class Items:
    """A block of items as the matrix term x item: each term's items and how often these hold it."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        place = self.vocabulary.setdefault
        entries = [(place(t, len(self.vocabulary)), k, n) for k, (_, text) in enumerate(rows) for t, n in Counter(terms(text)).items()]
        term, item, times = (np.array(c, np.int64) for c in (zip(*entries, strict=True) if entries else ([], [], [])))
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order].astype(np.int32), times[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))]).astype(np.int64)


def term_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tf`` of every document with a term: its length, and what it holds of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, found, tf = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                held = [(vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary]
                ids.append(doc_id)
                sizes.append(len(words))
                found.append([t for t, _ in held])
                tf.append([n for _, n in held])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip((ids, sizes, found, tf), kinds, strict=True)], ["doc_id", "n", "terms", "tf"]
            )

    schema = "doc_id long, n long, terms array<int>, tf array<int>"
    return map_arrow(picked(docs, doc_id="long", text="string"), count, schema)


def weights(rows: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term of the vocabulary, number of documents and of terms in them."""
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    # At most one row for each term of a block of items.
    held = rows.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df = np.zeros(n_terms, np.int64)
    df[held.column("t").to_numpy()] = held.column("count").to_numpy()
    w = np.floor(1000 * np.log((2 * total["docs"] + 2) / (2 * df + 1)))
    return w.astype(np.int64), total["docs"], total["words"] or 0


class Best:
    """The best ``k`` documents of each item among those seen."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """``scores`` has a row for each document and a column for each item."""
        row, item = np.nonzero(scores >= self.least)
        self.parts.append((item, scores[row, item], doc[row], null[row]))
        self.held += len(row)
        if self.held > HELD:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        item, score, doc, null = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        new = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(new, np.diff(new, append=len(item)))
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        self.parts = [tuple(c[rank < self.k] for c in (item, score, doc, null))]
        self.held = len(self.parts[0][0])
        return self.parts[0]


def products(items: Items, impact: np.ndarray, term: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Scores of blocks of rows: first row, row behind the last, and a dense int64 array of rows by items.

    ``impact`` and ``term`` hold the entries of all rows, ``ends`` where each row's entries end.
    """
    n_items, size = len(items.ids), items.begin[term + 1] - items.begin[term]
    work = np.concatenate([[0], np.cumsum(size)])
    upto = work[ends]
    first, most = 0, max(1, CELLS // max(1, n_items))
    while first < len(ends):
        before = upto[first - 1] if first else 0
        behind = min(first + most, max(first + 1, int(np.searchsorted(upto, before + CELLS, side="right"))))
        a, e = ends[first - 1] if first else 0, ends[behind - 1]
        n = size[a:e]
        out = np.zeros((behind - first, n_items), np.int64)
        row = np.repeat(np.arange(behind - first), np.diff(ends[first:behind], prepend=a))
        at = np.repeat(items.begin[term[a:e]] - (work[a:e] - work[a]), n) + np.arange(work[e] - work[a])
        np.add.at(out.ravel(), np.repeat(row * n_items, n) + items.item[at], np.repeat(impact[a:e], n) * items.times[at])
        yield first, behind, out
        first = behind


def _search(rows: DataFrame, items: Items, k: int) -> DataFrame:
    """``item, item_id, doc_id, score``: the best of each task."""
    w, n_docs, n_words = weights(rows, len(items.vocabulary))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k)
        for b in batches:
            doc = b.column("doc_id")
            null = np.array(doc.is_null())
            doc = doc.fill_null(0).to_numpy()
            # Python's integers: n * N may go beyond 64 bits.
            m = np.array([25 + 75 * n * n_docs // n_words for n in b.column("n").to_pylist()], np.int64)
            ends = np.cumsum(np.array(b.column("terms").value_lengths(), np.int64))
            term, tf = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
            impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(ends, prepend=0))))
            for first, behind, scores in products(items, impact, term, ends):
                best.add(scores, doc[first:behind], null[first:behind])
        item, score, doc, null = best.reduce()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item.astype(np.int32)),
                pa.array([items.ids[i] for i in item], pa.int64()),
                pa.array(doc, pa.int64(), mask=null.astype(bool)),
                pa.array(score),
            ],
            ["item", "item_id", "doc_id", "score"],
        )

    return map_arrow(rows, search, "item int, item_id long, doc_id long, score long", batch_rows=2_000)


def lexical_search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0."""
    asked = picked(benchmark, item_id="long", text="string").where("text is not null")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(chars) // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = None
    for block in range(n):
        items = Items([(r.item_id, r.text) for r in asked.where(part == block).collect()])
        rows = materialize(term_rows(docs, items.vocabulary), "term-rows")
        found = _search(rows, items, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found.select("item_id", "rank", "doc_id", "score")
        if n > 1:
            found = materialize(found, "ranked", instead_of=(rows,))
        out = found if out is None else out.unionByName(found)
    return out
