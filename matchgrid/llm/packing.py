"""Best-fit packing of token sequences by swap-based local search.

Documents are tokenized, ended by one token, and cut where longer than a
sequence. Pieces are dealt evenly into blocks of a bounded number of pieces;
each block is packed best-fit decreasing and then improved by local search:
documents of the emptiest bin are moved to, or exchanged one-for-one or
two-for-one with documents of, fuller bins, and underfull bins exchange
documents among each other. Every step raises the sum of squared fills, so it
ends: when the block has as few bins as its tokens allow, or when no exchange
is left. The emptiest bins of all blocks are then packed once more together, in
blocks again while there are many, so that blocks do not cost a bin each.

Tokenizing cuts texts at white space and looks the chunks up in a bounded cache
of the tokenizer's own results; texts with characters for which that is
not exactly the tokenizer's reading of the whole text go to it whole.

Edge cases: a null or empty text is one end token. A text of any length is
tokenized whole, and gives a full sequence for each 4096 of its tokens. Of bins
that fit equally well the one opened first is taken, and of equally good
exchanges the first found; which of equal pieces lies where is not defined.
Repeated rows are packed each on its own. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, picked, worker_cache

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Pieces packed together, about; bounds a packing task.
BLOCK_PIECES = 20_000
#: Chunks whose ids a Python worker remembers.
CACHE_CHUNKS = 300_000

#: Texts of these characters only are read chunk by chunk: no other white
#: space, nothing that normalization joins, plain lower-casing, and no numbers
#: but digits (superscripts and fractions are word characters to a pattern).
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")


#: A word, with or without punctuation: their ids follow one another.
PUNCTUATED = re.compile(r"([^\W\d_]+)([^\w\s']*)")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Results for chunks are kept in two generations of bounded size: what a
    batch uses is in the newer, and the older goes when that is full.
    """

    def __init__(self, path: str):
        kept, key = worker_cache(), ("encoder", path)
        if key not in kept:
            whole = tokenizers.Tokenizer.from_file(path)
            kept[key] = (whole, self._words_only(whole), [{}, {}])
        self.tokenizer, self.words, self.cache = kept[key]

    @staticmethod
    def _words_only(whole: tokenizers.Tokenizer) -> tokenizers.Tokenizer | None:
        """The same model, in memory once, for single lower-case words and runs of punctuation.

        None where the tokenizer does not drop white space and part words from
        punctuation, lower-casing first; texts then go to it whole.
        """
        pre, norm = (json.loads(x.__getstate__()) if x else {} for x in (whole.pre_tokenizer, whole.normalizer))
        steps = pre.get("pretokenizers") or [{}]
        norms = [n["type"] for n in norm.get("normalizers", [])]
        if (
            [x.get("type") for x in steps] != ["Split", "ByteLevel"]
            or (steps[0]["behavior"], steps[0]["invert"]) != ("Removed", True)
            or not steps[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            or norms != ["NFC", "Replace", "Lowercase"]
        ):
            return None
        words = tokenizers.Tokenizer(whole.model)
        words.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(**{k: v for k, v in steps[1].items() if k in ("add_prefix_space", "use_regex")})
        return words

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def _read(tokenizer: tokenizers.Tokenizer, chunks: list[str]) -> dict[str, bytes]:
        """The tokenizer's own reading of each chunk, all in one call."""
        out = dict.fromkeys(chunks, b"")
        if chunks:
            got = tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(got.ids, dtype="<u4"), np.array(got.word_ids)
            raw, cuts = ids.tobytes(), np.flatnonzero(np.diff(owner)) + 1
            first = np.concatenate([[0], cuts])
            ends = (4 * np.concatenate([cuts, [len(ids)]])).tolist()
            for n, a, e in zip(owner[first].tolist(), (4 * first).tolist(), ends, strict=True):
                out[chunks[n]] = raw[a:e]
        return out

    def _known(self, chunks: set[str]) -> dict[str, bytes]:
        """The newer generation, after all chunks are in it."""
        new, old = self.cache
        if len(new) > CACHE_CHUNKS:
            self.cache[:] = new, old = [{}, new]
        absent = chunks.difference(new)
        if not absent:
            return new
        kept = absent.intersection(old)
        new.update(zip(kept, map(old.__getitem__, kept), strict=True))
        absent -= kept
        # What is letters only is a word as it stands.
        words = set(filter(str.isalpha, absent))
        parts, others = [], []
        split = PUNCTUATED.fullmatch
        for c in absent.difference(words):
            m = split(c)
            if m is None:
                others.append(c)
            else:
                parts.append((c, *m.groups()))
        words.update(p[1] for p in parts)
        words.update(p[2] for p in parts)
        words.discard("")
        new.update(self._read(self.words, list(words.difference(new))))
        new.update(self._read(self.tokenizer, others))
        new[""] = b""
        for c, word, marks in parts:
            new[c] = new[word] + new[marks]
        return new

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # Nothing here makes cycles, and Python's collector would visit all words of a batch again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str | None]) -> list[bytes]:
        plain = [None if not t or self.words is None or "<|" in t or not PLAIN.fullmatch(t) else t.lower().split() for t in texts]
        get = self._known(set().union(*(p for p in plain if p is not None))).__getitem__
        return [
            b"".join(map(get, p)) if p is not None else self.whole(t) if t else b""
            for p, t in zip(plain, texts, strict=True)
        ]


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_TOKENS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        for b in batches:
            out = []
            texts = b.column("text").to_pylist()
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * limit):
                    part = ids[k : k + 4 * limit]
                    out.append((doc_id, k // (4 * limit), k // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_arrow(
        picked(docs, doc_id="long", text="string"),
        cut,
        "doc_id long, piece int, start long, length long, ids_crc32 long",
        cached=True,
    )


class Bins:
    """Bins of one block; ``by_free`` finds the tightest bin that has room."""

    def __init__(self, limit: int):
        self.limit = limit
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, set[int]] = {}
        self.mask = 0

    def _enter(self, b: int) -> None:
        f = self.free[b]
        self.by_free.setdefault(f, set()).add(b)
        self.mask |= 1 << f

    def _leave(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].discard(b)
        if not self.by_free[f]:
            self.mask &= ~(1 << f)

    def tightest(self, size: int) -> int | None:
        room = self.mask >> size
        if not room:
            return None
        return min(self.by_free[size + (room & -room).bit_length() - 1])

    def open(self) -> int:
        self.items.append([])
        self.free.append(self.limit)
        self._enter(len(self.free) - 1)
        return len(self.free) - 1

    def put(self, b: int, item: int, size: int) -> None:
        self._leave(b)
        self.items[b].append(item)
        self.free[b] -= size
        self._enter(b)

    def take(self, b: int, item: int, size: int) -> None:
        self._leave(b)
        self.items[b].remove(item)
        self.free[b] += size
        self._enter(b)

    def hide(self, b: int) -> None:
        self._leave(b)

    def show(self, b: int) -> None:
        self._enter(b)


def pack_block(sizes: list[int], limit: int = SEQUENCE_TOKENS) -> list[int]:
    """The bin of each size; best-fit decreasing, then swap-based local search."""
    bins = Bins(limit)
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = bins.tightest(sizes[i])
        b = bins.open() if b is None else b
        bins.put(b, i, sizes[i])
        where[i] = b
    least = -(-sum(sizes) // limit)
    used = len(bins.free)
    size_of = np.array(sizes, dtype=np.int64)
    while used > least:
        emptiest = max((b for b in range(len(bins.free)) if bins.items[b]), key=lambda b: (bins.free[b], b))
        if _empty(bins, emptiest, size_of, where):
            used -= 1
        elif not _exchange(bins, size_of, where):
            break
    return where


def _exchange(bins: Bins, size_of: np.ndarray, where: list[int]) -> bool:
    """One sweep over the underfull bins, fullest first: each takes a larger document
    of a bin no fuller for one of its own, as large as its room allows. Room
    gathers in the emptier bins. Returns whether anything moved."""
    free, at = np.array(bins.free), np.array(where)
    moved = False
    for a in sorted((b for b in range(len(free)) if bins.items[b] and free[b] > 0), key=lambda b: (free[b], b)):
        room, best = int(free[a]), (0, -1, -1)
        if not room:
            continue
        less = (free[at] >= room) & (at != a)
        # Documents of one length are alike.
        for y in {int(size_of[i]): i for i in bins.items[a]}.values():
            fits = less & (size_of > size_of[y]) & (size_of <= size_of[y] + room)
            if fits.any():
                x = int(np.argmax(np.where(fits, size_of, 0)))
                best = max(best, (int(size_of[x] - size_of[y]), x, y))
        gain, x, y = best
        if gain:
            b = int(at[x])
            for item, to, frm in ((x, a, b), (y, b, a)):
                bins.take(frm, item, int(size_of[item]))
                where[item] = at[item] = to
            bins.put(a, x, int(size_of[x]))
            bins.put(b, y, int(size_of[y]))
            free[a] -= gain
            free[b] += gain
            moved = True
    return moved


def _sums(own: list[int], size_of: np.ndarray) -> dict[int, tuple[int, ...]]:
    """Every total of one or two documents of a bin, with documents that make it.

    Documents of one length are alike, so a bin of 4096 tokens has at most 90
    lengths to be paired.
    """
    of: dict[int, list[int]] = {}
    for i in own:
        of.setdefault(int(size_of[i]), []).append(i)
    out: dict[int, tuple[int, ...]] = {s: (v[0],) for s, v in of.items()}
    lengths = list(of)
    for k, s in enumerate(lengths):
        if len(of[s]) > 1:
            out.setdefault(2 * s, (of[s][0], of[s][1]))
        for r in lengths[k + 1 :]:
            out.setdefault(s + r, (of[s][0], of[r][0]))
    return out


def _empty(bins: Bins, e: int, size_of: np.ndarray, where: list[int]) -> bool:
    """Moves and exchanges documents of bin ``e`` into fuller bins until none is left."""
    free = np.array(bins.free)
    at = np.array(where)
    bins.hide(e)

    def shift(item: int, b: int) -> None:
        size = int(size_of[item])
        old = where[item]
        for bin_, sign in ((old, 1), (b, -1)):
            if bin_ != e:
                bins._leave(bin_)
            bins.free[bin_] += sign * size
            free[bin_] += sign * size
            if bin_ != e:
                bins._enter(bin_)
        bins.items[old].remove(item)
        bins.items[b].append(item)
        where[item] = b
        at[item] = b

    while bins.items[e]:
        moved = False
        for x in sorted(bins.items[e], key=lambda i: -size_of[i]):
            b = bins.tightest(int(size_of[x]))
            if b is not None:
                shift(x, b)
                moved = True
        if moved:
            continue
        # Exchange for a smaller document of a bin that has room for the rest;
        # the gain in that bin is as large as can be.
        room = np.where(at == e, -1, free[at])
        best: tuple[int, tuple[int, ...], int] | None = None
        for total, group in _sums(sorted(bins.items[e], key=lambda i: -size_of[i]), size_of).items():
            gain = total - size_of
            ok = (room >= gain) & (gain > 0) & (at != e)
            if ok.any():
                y = int(np.argmax(np.where(ok, gain, 0)))
                if best is None or gain[y] > best[0]:
                    best = (int(gain[y]), group, y)
        if best is None:
            bins.show(e)
            return False
        _, group, y = best
        b = where[y]
        shift(y, e)
        for x in group:
            shift(x, b)
    return True


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(batches: Iterator[pa.RecordBatch], limit: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Packs one block; ``again`` marks the pieces of its emptiest bin."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).combine_chunks()
    order = t.column("length").to_pylist()
    where = pack_block(order, limit)
    fill: dict[int, int] = {}
    offset = []
    for size, b in zip(order, where, strict=True):
        offset.append(fill.get(b, 0))
        fill[b] = offset[-1] + size
    names = {b: n for n, b in enumerate(sorted(fill))}
    emptiest = min(fill, key=lambda b: (fill[b], b))
    base = turn << 56 | t.column("block")[0].as_py() << 24
    t = t.drop_columns(["block"])
    t = t.append_column("sequence_id", pa.array([base + names[b] for b in where], pa.int64()))
    t = t.append_column("offset", pa.array(offset, pa.int64()))
    yield from t.append_column("again", pa.array([b == emptiest for b in where], pa.bool_())).to_batches()


def pack(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset`` in its sequence."""
    todo = materialize(pieces(docs, tokenizer_path, limit), "pieces")
    out, turn, before = None, 0, None
    while True:
        blocks = max(1, -(-todo.count() // block_pieces))
        # Bins that hold whole blocks leave nothing to gain from another turn.
        last = blocks == 1 or (before is not None and blocks >= before)
        # Round robin: every block gets as many pieces, whatever their keys.
        dealt = todo.repartition(blocks).withColumn("block", F.spark_partition_id().cast("long"))

        def place(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            return _place(batches, limit, turn)

        placed = map_arrow(dealt, place, f"{PLACED}, again boolean")
        if not last:
            placed = materialize(placed, "packed", instead_of=(todo,))
            done = placed.where("not again").drop("again")
        else:
            done = placed.drop("again")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        # The emptiest bins of the blocks meet: less than a bin of each block.
        todo = materialize(placed.where("again").select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
        turn, before = turn + 1, blocks
