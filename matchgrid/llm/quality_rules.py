"""Quality rules: line labelling with a linear-chain conditional random field.

Every line of a document gets categorical features; Viterbi decoding of a
two-label linear-chain CRF marks it content or boilerplate, and the share of
word characters on content lines decides whether the document is kept.
Counting rules (too few words, too many repeated words) fail a document first.

The CRF is trained here, on a bounded, documented sample of labelled documents
(``SAMPLE_PER_CLASS`` documents of each quality label, chosen by hash). Labels
are given for documents, not lines, so line labels are inferred: a first model
without transitions, fitted as if all lines had their document's label, tells
which lines of a document are unlike its label, and these change sides, as long
as most of the characters of a low-quality document stay boilerplate and most
of another stay content. Documents thus get mixed labels, from which the chain
learns where content and boilerplate meet; its own paths label the lines of the
last round. Training is on the driver (a few thousand short integer sequences);
scoring is one pass over all rows without a shuffle.

Edge cases: a text of any length is decoded whole; of equally likely paths the
one that ends in content is taken. Null or empty text has no words and fails the word rule; a text of
white space likewise. Repeated rows are scored each on its own. An empty table
gives an empty result. Without labels of both classes every line counts as
content. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, picked, utf8

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
#: Labelled documents of each class that the CRF is fitted on, at most.
SAMPLE_PER_CLASS = 800
#: Lines of one training sequence; longer documents are cut into several.
TRAIN_LINES = 32

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LETTER_BYTES = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
UPPER_BYTES = bytes(range(65, 91))
SYMBOL_BYTES = b"#*$%&|<>!"

BOILERPLATE, CONTENT = 0, 1
#: Values of each categorical feature.
WIDTHS = (12, 6, 6, 5, 6, 2, 5, 3, 2, 5)
OFFSETS = tuple(int(x) for x in np.concatenate([[0], np.cumsum(WIDTHS)[:-1]]))
N_FEATURES = int(sum(WIDTHS))


def _bin(x: float, edges: tuple[float, ...]) -> int:
    n = 0
    for e in edges:
        if x < e:
            break
        n += 1
    return n


def line_features(lines: list[bytes]) -> list[tuple[int, ...]]:
    """One index per categorical feature and line, into a shared weight vector."""
    out, seen, last = [], set(), len(lines) - 1
    for i, line in enumerate(lines):
        n = max(1, len(line))
        words = line.split()
        nw = max(1, len(words))
        symbols = n - len(line.translate(None, SYMBOL_BYTES))
        letters = n - len(line.translate(None, LETTER_BYTES))
        upper = n - len(line.translate(None, UPPER_BYTES))
        values = (
            min(11, n.bit_length()),
            _bin(symbols / n, (0.001, 0.02, 0.06, 0.15, 0.3)),
            _bin(letters / n, (0.3, 0.5, 0.65, 0.75, 0.85)),
            _bin(upper / max(1, letters), (0.01, 0.1, 0.3, 0.6)),
            _bin(n / nw, (3, 4.5, 6, 8, 12)),
            int(line.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"')),
            _bin(len(set(words)) / nw, (0.2, 0.5, 0.7, 0.9)),
            0 if i == 0 else 2 if i == last else 1,
            int(line in seen),
            _bin(sum(line.count(c) for c in (b",", b".", b";")) / nw, (0.01, 0.05, 0.12, 0.4)),
        )
        seen.add(line)
        out.append(tuple(v + o for v, o in zip(values, OFFSETS, strict=True)))
    return out


def viterbi(scores: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best label path of one sequence; scores is (lines, 2). Ties go to content."""
    back: list[tuple[int, int]] = []
    b, c = map(float, scores[0])
    (tbb, tbc), (tcb, tcc) = trans.tolist()
    for sb, sc in scores[1:].tolist():
        bb, cb, bc, cc = b + tbb, c + tcb, b + tbc, c + tcc
        back.append((int(cb >= bb), int(cc >= bc)))
        b, c = max(bb, cb) + sb, max(bc, cc) + sc
    label = int(c >= b)
    path = [label]
    for step in reversed(back):
        label = step[label]
        path.append(label)
    return path[::-1]


Line = tuple[int, ...]
#: Features and sizes of a document's lines, and its label.
Sequence = tuple[list[Line], list[int], int]


def maximize(
    sequences: list[Sequence], labels: list[np.ndarray], chain: bool = True, epochs: int = 60, l2: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of line labels with forward-backward and Adam; (weights, transitions).

    Without ``chain`` the transitions stay zero and lines are independent.
    """
    cuts = [(s[i : i + TRAIN_LINES], y[i : i + TRAIN_LINES], d) for (s, _, d), y in zip(sequences, labels, strict=True) for i in range(0, len(s), TRAIN_LINES)]
    t_max = max(len(s) for s, _, _ in cuts)
    x = np.zeros((len(cuts), t_max, len(WIDTHS)), np.int64)
    mask, y = np.zeros((len(cuts), t_max)), np.zeros((len(cuts), t_max), np.int64)
    kind = np.array([d for _, _, d in cuts])
    for i, (s, lab, _) in enumerate(cuts):
        x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = s, lab, 1
    # Both kinds of documents weigh the same, however many lines each has.
    lines = np.array([mask[kind == k].sum() for k in (0, 1)])
    share = (lines.sum() / (2 * lines))[kind]
    total = mask.sum()
    flat = x.reshape(-1)
    scale = mask * share[:, None]
    empirical = np.stack([np.bincount(flat, np.repeat((scale * (y == k)).ravel(), len(WIDTHS)), N_FEATURES) for k in (0, 1)], 1)
    both = scale[:, 1:]
    seen_pairs = np.array([[(both * (y[:, :-1] == j) * (y[:, 1:] == k)).sum() for k in (0, 1)] for j in (0, 1)])
    params = np.zeros(N_FEATURES * 2 + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, epochs + 1):
        weights, trans = params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)
        emit = weights[x].sum(2) * mask[:, :, None]
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, t_max):
            nxt = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, nxt, alpha[:, t - 1])
        for t in range(t_max - 2, -1, -1):
            into = emit[:, t + 1] + beta[:, t + 1]
            prv = np.logaddexp(trans[:, 0] + into[:, 0, None], trans[:, 1] + into[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, prv, 0)
        logz = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        prob = np.exp(alpha + beta - logz[:, None, None]) * scale[:, :, None]
        expected = np.stack(
            [np.bincount(flat, np.repeat(prob[:, :, k].ravel(), len(WIDTHS)), N_FEATURES) for k in (0, 1)], 1
        )
        joint = (
            alpha[:, :-1, :, None] + trans[None, None] + (emit + beta)[:, 1:, None, :] - logz[:, None, None, None]
        )
        pair = (np.exp(np.minimum(joint, 0)) * both[:, :, None, None]).sum((0, 1))
        grad = np.concatenate([(expected - empirical).ravel(), chain * (pair - seen_pairs).ravel()]) / total + l2 * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return params[:-4].reshape(-1, 2), params[-4:].reshape(2, 2)


def line_labels(sequence: Sequence, weights: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best path of a document whose label holds for at least half of its characters.

    Where the path says otherwise, the lines that least fit it go back to the
    document's label.
    """
    lines, sizes, own = sequence
    scores, size = weights[np.array(lines)].sum(1), np.array(sizes)
    path = np.array(viterbi(scores, trans))
    lead = scores[:, own] - scores[:, 1 - own]
    for i in np.argsort(-lead, kind="stable"):
        if 2 * size[path == own].sum() > size.sum():
            break
        path[i] = own
    return path


def fit_crf(sequences: list[Sequence], rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) from documents with one label each, by labelling their lines in turns."""
    weights, trans = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if len({y for *_, y in sequences}) < 2:
        weights[:, CONTENT] = 1.0
        return weights, trans
    labels = [np.full(len(s), y) for s, _, y in sequences]
    weights, trans = maximize(sequences, labels, chain=False)
    for _ in range(rounds):
        labels = [line_labels(s, weights, trans) for s in sequences]
        weights, trans = maximize(sequences, labels)
    return weights, trans


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def assess(text: str | None, weights: np.ndarray, trans: np.ndarray) -> tuple:
    """The counts and verdicts of one document."""
    text = text or ""
    raw = utf8(text)
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(raw.count, (c.encode() for c in SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    share = 0.0
    if lines:
        scores = weights[np.array(line_features(lines))].sum(1)
        path = viterbi(scores, trans)
        sizes = line_sizes(lines)
        share = sum(s for s, p in zip(sizes, path, strict=True) if p == CONTENT) / max(1, sum(sizes))
    kept = not failed and share >= MIN_CONTENT_SHARE
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, kept, share


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, content_share double"
)
ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())]
)


def line_sizes(lines: list[bytes]) -> list[int]:
    """Bytes of each line without blanks."""
    return [len(x) - x.count(b" ") for x in lines]


def training_sequences(docs: DataFrame, labels: DataFrame) -> list[Sequence]:
    """Line features and sizes of at most ``SAMPLE_PER_CLASS`` labelled documents a class."""
    lab = picked(labels, doc_id="long", quality="int").where("doc_id is not null and quality in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = None
    for k in (0, 1):
        part = lab.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        sample = part if sample is None else sample.unionByName(part)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sizes = [], []
            for text in b.column("text").to_pylist():
                lines = [x for x in utf8(text).split(b"\n") if x.strip()]
                rows.append([list(f) for f in line_features(lines)])
                sizes.append(line_sizes(lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.list_(pa.int32()))), pa.array(sizes, pa.list_(pa.int32())), b.column("quality")],
                ["lines", "sizes", "quality"],
            )

    # At most 2 * SAMPLE_PER_CLASS ids, so the broadcast has a fixed bound.
    joined = picked(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id")
    rows = map_arrow(joined.select("text", "quality"), features, "lines array<array<int>>, sizes array<int>, quality int").collect()
    return sorted(([tuple(f) for f in r.lines], list(r.sizes), r.quality) for r in rows if r.lines)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, rule failures, content share and the keep verdict of every document."""
    weights, trans = fit_crf(training_sequences(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [assess(t, weights, trans) for t in b.column("text").to_pylist()]
            cols = list(zip(*found, strict=True)) or [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, ARROW.field(i + 1).type) for i, c in enumerate(cols)]], schema=ARROW
            )

    return map_arrow(picked(docs, doc_id="long", text="string"), score, SCHEMA)
