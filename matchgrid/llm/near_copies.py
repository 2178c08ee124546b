"""Near copies by an exact Jaccard join of five-word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of at least ``SIMILARITY``. The join is exact: under one order of all
shingles, such sets share a shingle of their prefixes (all but the required
overlap less one). The order is that of the hashes, with shingles that a sample
finds frequent last, so that passages of many documents seldom are in a prefix;
any order loses nothing. Of each prefix shingle, all members are first compared
with its smallest member, which joins large groups by one link a document; then
members of different components are compared with each other, if their sizes
and what lies behind the shingle leave room for the required overlap. Every
link is verified on the whole sets.

No shingle's members are gathered: smallest members come from an aggregation,
frequent shingles are joined by ``join_keyed``, and members that are compared
with each other lie in parts of bounded size.

Edge cases: fewer words than a shingle count as one shingle; a text without
words is no near copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, join_keyed, map_arrow, materialize, utf8
from .components import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: One of so many documents is in the sample; a shingle in so many of these is frequent.
SAMPLE, FREQUENT = 16, 4
#: Frequent shingles that travel with the plan at most (8 bytes each).
MAX_FREQUENT = 100_000
#: Pairs that share a copy of their first text when they are verified, about.
TEXT_PAIRS = 256
#: Members of a shingle that are compared with each other in one place, about.
PART_ROWS = 4_096


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's shingles: polynomials of the hashes of their words."""
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h = h * FACTOR + own[k : k + len(h)]
    h ^= h >> np.uint64(32)
    h *= FACTOR
    h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    late = np.isin(found, frequent, assume_unique=True)
    n = len(found)
    return np.concatenate([found[~late], found[late]])[: n - ceil(SIMILARITY * n - 1e-9) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both >= SIMILARITY * (len(a) + len(b) - both) - 1e-9


def _frequent(texts: DataFrame) -> np.ndarray:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text))], ["s"])

    sample = texts.where(F.pmod("h", F.lit(SAMPLE)) == 0).select("text")
    often = map_arrow(sample, explode, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT)
    rows = often.orderBy(F.desc("count"), "s").limit(MAX_FREQUENT).select("s").collect()
    return np.array([r.s for r in rows], dtype=np.int64)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members of different components that can still reach the similarity.

    Rows come sorted by group and size; a group is two parts of one shingle's members.
    """
    names = ["group", "n", "h", "root", "rest", "part", "low"]
    held = [np.empty(0, np.int64) for _ in names]

    def run(cols: list[np.ndarray]) -> pa.RecordBatch:
        group, n, h, root, rest, part, low = cols
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [len(group)]])
        share = SIMILARITY / (1 + SIMILARITY)
        for a, e in zip(at[:-1], at[1:], strict=True):
            if e - a < 2 or (root[a:e] == root[a]).all():
                continue
            for i in range(a, e - 1):
                end = a + int(np.searchsorted(n[a:e], n[i] / SIMILARITY + 1e-9, side="right"))
                j = slice(i + 1, end)
                fits = root[j] != root[i]
                # Two parts meet here; pairs within one have a group of their own.
                fits &= (part[j] != part[i]) if low[i] >= 0 else True
                fits &= np.minimum(rest[j], rest[i]) >= share * (n[j] + n[i]) - 1e-9
                other = h[j][fits]
                us.append(np.minimum(h[i], other))
                vs.append(np.maximum(h[i], other))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    for b in batches:
        held = [np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(held, names, strict=True)]
        done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if done:
            yield run([x[:done] for x in held])
            held = [x[done:] for x in held]
    if len(held[0]):
        yield run(held)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, None
        for b in batches:
            us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
            out = []
            for u, v, x, y in zip(us, vs, b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if u != held:
                    held, mine = u, shingles(x)
                if similar(mine, shingles(y)):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["u", "v"]
            )

    # Only texts that are in a pair move; one that is in many pairs is there once for each part of them.
    pairs = materialize(pairs, "near-pairs")
    ends = materialize(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "h"), "near-ends")
    own = materialize(among(texts, ends, "h"), "near-texts", instead_of=(ends,))
    counts = materialize(pairs.groupBy("u").agg(F.count("*").alias("n_rows")), "near-counts")
    parts = F.ceil(F.col("n_rows") / TEXT_PAIRS).cast("int")
    dealt = join_keyed(pairs, counts.withColumn("parts", parts), "u").withColumn("part", F.pmod(F.hash("v"), F.col("parts"))).drop("parts")
    first = counts.select(F.col("u"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    first = first.join(own.select(F.col("h").alias("u"), F.col("text").alias("x")), "u")
    both = dealt.join(own.select(F.col("h").alias("v"), F.col("text").alias("y")), "v").join(first, ["u", "part"])
    links = materialize(map_arrow(both.select("u", "v", "x", "y"), verify, "u long, v long"), "near-links", instead_of=(pairs, own, counts))
    return links


def near_copy_components(texts: DataFrame) -> DataFrame:
    """``node, root`` for the ``h`` of every near copy; ``texts`` has distinct ``h`` and ``text``."""
    frequent = _frequent(texts)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(shingles(t), h) for t, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist(), strict=True)]
            parts = [(prefix(s, frequent), len(s), h) for s, h in parts if len(s)]
            sizes = [len(p) for p, _, _ in parts]
            none = [np.empty(0, np.int64)]
            cols = [
                np.concatenate([p for p, _, _ in parts] or none),
                np.repeat(np.array([h for _, _, h in parts], np.int64), sizes),
                np.repeat(np.array([n for _, n, _ in parts], np.int64), sizes),
                # Shingles of the text from the key on: what can be shared if none before it is.
                np.concatenate([n - np.arange(len(p)) for p, n, _ in parts] or none),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "h", "n", "rest"])

    rows = map_arrow(texts.select("h", "text"), keys, "key long, h long, n long, rest long")
    every = materialize(rows, "near-keys")
    # Most shingles are of one text only, and go first.
    again = every.groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select("key")
    again = materialize(again, "near-again")
    rows = materialize(among(every, again, "key"), "near-rows", instead_of=(every, again))
    heads = rows.groupBy("key").agg(F.min(F.struct("h", "n", "rest")).alias("head"), F.count("*").alias("n_rows"))
    heads = materialize(heads.where("n_rows > 1"), "near-heads")
    members = materialize(join_keyed(rows, heads, "key"), "near-members", instead_of=(rows,))
    share = SIMILARITY / (1 + SIMILARITY)
    sized = F.least("n", "head.n") >= SIMILARITY * F.greatest("n", "head.n") - 1e-9
    sized &= F.least("rest", "head.rest") >= share * (F.col("n") + F.col("head.n")) - 1e-9
    stars = members.where((F.col("h") != F.col("head.h")) & sized).select(F.col("head.h").alias("u"), F.col("h").alias("v"))
    stars = materialize(stars.distinct(), "near-stars")
    links = _verified(stars, texts)
    roots = connected_components(links).withColumnRenamed("node", "h")
    rest = members.join(roots, "h", "left").select("key", "n", "h", "rest", F.coalesce("root", "h").alias("root"))
    rest = materialize(rest, "near-rest", instead_of=(members,))
    mixed = rest.groupBy("key").agg(F.count("*").alias("n_rows"), F.min("root").alias("a"), F.max("root").alias("b"))
    mixed = mixed.where("a < b").select("key", "n_rows", F.ceil(F.col("n_rows") / PART_ROWS).cast("int").alias("parts"))
    rest = join_keyed(rest, materialize(mixed, "near-mixed"), "key")
    # Every two parts of a key's members meet once, and each part meets itself.
    rest = rest.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rest = rest.select("key", "n", "h", "rest", "root", "part", other)
    low = F.when(F.col("part") == F.col("other"), -1 - F.col("part")).otherwise(F.least("part", "other"))
    rest = rest.withColumn("low", low).withColumn("group", F.xxhash64("key", "low", F.greatest("part", "other")))
    rest = rest.repartition("group").sortWithinPartitions("group", "n", "h")
    across = map_arrow(
        rest.select("group", "n", "h", "root", "rest", F.col("part").cast("long").alias("part"), F.col("low").cast("long").alias("low")),
        _across,
        "u long, v long",
        batch_rows=20_000,
    ).distinct()
    across = across.join(stars, ["u", "v"], "left_anti")
    return connected_components(links.unionByName(_verified(across, texts)))
