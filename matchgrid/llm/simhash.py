"""SimHash near-duplicates with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 values of its
three-word shingles. Documents with equal fingerprints are one class from the
start; only distinct fingerprints are compared. Two fingerprints at most two
bits apart agree on two of their four 16-bit blocks, so each fingerprint goes
to the six shards named by a pair of its blocks, and a shard's BK-tree
(children keyed by the Hamming distance to the parent, only edges within the
radius followed) meets every partner. The trees are not broadcast: a tree over
all fingerprints has no size bound, whereas shards travel by one shuffle and
only along matching blocks. A shard holds distinct fingerprints that agree on
32 bits, so a group of near copies fills it with few values however many
documents it has. Each tree gives a spanning forest of its links, at most one
link per fingerprint, and a distributed component search joins them.

Edge cases: a null or empty text, or one of white space, has fingerprint zero
and links like any other; fewer words than a shingle count as one shingle.
Repeated rows share their component. A null doc_id is kept and never names a
component unless all its members are null. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, join_keyed, map_arrow, materialize, picked, utf8
from .components import connected_components
from .near_copies import near_copy_components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Bits set in each byte value, most significant bit first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text."""
    words = utf8(text).lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= words_per_shingle:
        return digest(joined, SEED)
    sizes = list(map(len, words))
    ends = list(accumulate(sizes, lambda a, b: a + 1 + b))
    starts = [0, *(x + 1 for x in ends)]
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :], strict=False)]
    lanes = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8) + LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, h, fp``: fp as a signed long, h a hash of the text."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"]
            )

    named = picked(docs, doc_id="long", text="string").withColumn("h", F.xxhash64("text"))
    return map_arrow(named, hash_all, "doc_id long, h long, fp long")


class BKTree:
    """Values under a metric tree; each edge is the Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.kids: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of all values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            i = todo.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            kids = self.kids[i]
            if kids:
                todo += [kids[k] for k in range(max(1, d - radius), d + radius + 1) if k in kids]
        return found

    def add(self, value: int) -> None:
        if self.values:
            i = 0
            while True:
                d = (self.values[i] ^ value).bit_count()
                nxt = self.kids[i].get(d)
                if nxt is None:
                    self.kids[i][d] = len(self.values)
                    break
                i = nxt
        self.values.append(value)
        self.kids.append({})


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct values of a shard."""
    tree, up, out = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for n, value in enumerate(values):
        for i in tree.near(value, radius):
            a, b = root(i), root(n)
            if a != b:
                up[b] = a
                out.append((values[i], value))
        tree.add(value)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal shard keys; rows come sorted by key."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)

    def run(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        out = []
        for a, b in zip(starts, ends, strict=True):
            if b - a > 1:
                out += shard_links(fps[a:b].view(np.uint64).tolist())
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["u", "v"]
        )

    for b in batches:
        keys = np.concatenate([keys, b.column("key").to_numpy()])
        fps = np.concatenate([fps, b.column("fp").to_numpy()])
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done:
            yield run(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
    if len(keys):
        yield run(keys, fps)


def near_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links ``u, v`` that connect all distinct ``fp`` at most two bits apart."""
    block = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = [
        F.lit(n << 32) + F.shiftleft(block[i], 16) + block[j] for n, (i, j) in enumerate(pairs)
    ]
    shards = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    shards = shards.repartition("key").sortWithinPartitions("key", "fp")
    return map_arrow(shards, _links, "u long, v long", batch_rows=20_000).distinct()


def components(fps: DataFrame) -> DataFrame:
    """``fp, component_id, keep, n_rows`` of every fingerprint.

    n_rows counts its documents; keep is the (no_id, doc_id, h) of the document that stands for the
    component: the smallest id, rows without one last.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.min(place).alias("keep"), F.count("*").alias("n_rows"))
    classes = materialize(classes, "simhash-classes")
    roots = connected_components(near_fingerprints(classes.select("fp")))
    linked = materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp"), "simhash-linked")
    low = linked.groupBy("root").agg(F.min("component_id").alias("low"), F.min("keep").alias("low_keep"), F.count("*").alias("n_fps"))
    named = join_keyed(linked, low, "root", "n_fps").select("fp", "low", "low_keep")
    return classes.join(named, "fp", "left").select(
        "fp",
        F.coalesce("low", "component_id").alias("component_id"),
        F.coalesce("low_keep", "keep").alias("keep"),
        "n_rows",
    )


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    fps = materialize(fingerprints(docs), "simhash")
    # Copies share a fingerprint, so some fingerprints have very many rows.
    named = materialize(components(fps).drop("keep"), "simhash-components")
    return join_keyed(fps, named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Columns by which a row is told apart: its id (0 if null), whether that is null, and the hash of its text.
ROW = ["__id", "__none", "__h"]


def _keyed(docs: DataFrame) -> DataFrame:
    number = F.col("doc_id").cast("long")
    return docs.withColumns({"__id": F.coalesce(number, F.lit(0)), "__none": number.isNull(), "__h": F.xxhash64(F.col("text").cast("string"))})


def one_per_component(docs: DataFrame) -> DataFrame:
    """One document of each component: the one of the smallest id.

    Of rows that repeat both id and text one stays; columns as they came. Only
    lists of rows to leave out are made, and most rows never move.
    """
    fps = materialize(fingerprints(docs), "simhash")
    named = materialize(components(fps).select("fp", "keep", "n_rows"), "simhash-components")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    placed = join_keyed(fps, named, "fp")
    listed = placed.select(
        F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("h").alias("__h"), row.eqNullSafe(F.col("keep")).alias("stays")
    )
    listed = materialize(listed.groupBy(*ROW).agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("NOT stays OR n > 1"), "simhash-lists", instead_of=(fps, named))
    keyed = _keyed(docs)
    out = among(keyed, listed.select(*ROW), ROW, "left_anti")
    again = listed.where("stays").select(*ROW)
    if not again.isEmpty():
        out = out.unionByName(among(keyed, again, ROW).dropDuplicates(ROW))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Pipeline form: one document of each component, and of these one of each group of near copies.

    Near copies have five-word shingles of Jaccard similarity 0.8, directly or
    through others; the one of the smallest id stays. Columns as they came.
    """
    left = one_per_component(docs)
    keyed = _keyed(left)
    # Equal texts are one component, so each text is there once.
    texts = keyed.select(F.col("__h").alias("h"), F.col("text").cast("string").alias("text"))
    place = F.struct(F.col("__none").alias("no_id"), F.col("__id").alias("id"), F.col("__h").alias("h"))
    found = materialize(near_copy_components(texts), "near-found")
    own = among(keyed.select("__h", place.alias("place")), found.select(F.col("node").alias("__h")), "__h")
    placed = materialize(own.join(found, F.col("node") == F.col("__h")).select("root", "place"), "near-places", instead_of=(found,))
    stays = placed.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("n_rows"))
    gone = materialize(join_keyed(placed, stays, "root").where("place <> first").select(F.col("place.h").alias("__h")), "near-gone", instead_of=(placed,))
    return among(keyed, gone, "__h", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
