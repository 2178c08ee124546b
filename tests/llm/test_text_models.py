"""Language identification, ranked lexical search and periodic runs against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid.llm import language_id, lexical_search, periodic_runs, queries
from matchgrid.session import table

Q = queries.queries()
ROWS = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t 12 !", None),
    (4, "short text", "en"),
    (5, "the house and the garden", "en"),
    (5, "the house and the garden", "en"),
    (6, "word " * 30_000, "de"),
    (None, "das haus und der garten", "de"),
    (7, "naïve ßtraße 日本語 das haus", "de"),
    (9, "das haus und der garten und das haus", "de"),
    (11, "the garden", None),
]
CLASH = ["n", "terms", "tf", "rank", "score", "runs", "item", "item_id", "slot", "count", "k", "top"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# Language identification


def test_features_by_hand():
    slots, counts = language_id.features("  Ab\n a ")
    # " ab a " has 6, 5, 4 and 3 n-grams of one to four characters; " " occurs three times, "a" and " a" twice.
    assert counts.sum() == 18 and sorted(counts.tolist())[-3:] == [2, 2, 3] and (np.diff(slots) > 0).all()
    assert (language_id.features(" ab A")[0] == slots).all()
    assert language_id.features(None)[1].sum() == 2 + 1  # two spaces and their pair


def test_tf_idf_has_unit_length():
    idf = np.zeros(1 << language_id.SLOT_BITS, np.float32)
    slots, counts = language_id.features("some text of a few words")
    idf[slots[1:]] = 2.0
    kept, values = language_id.tf_idf(slots, counts, idf)
    assert (kept == slots[1:]).all() and abs(values @ values - 1) < 1e-5
    raw = 2 * (1 + np.log(counts[1:]))
    assert np.allclose(values, raw / np.sqrt((raw**2).sum()))


def test_document_frequencies(spark, sf):
    train = language_id.learnable(table(spark, sf, "documents"))
    rows = [r for r in table(spark, sf, "documents").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None]
    want = Counter(s for r in rows for s in language_id.features(r.text)[0].tolist())
    df, n = language_id.document_frequencies(train)
    assert n == len(rows) and {k: int(df[k]) for k in np.flatnonzero(df).tolist()} == dict(want)


def test_ftrl_is_sparse_and_right():
    """Two slots tell the classes apart, many tell nothing: only the former keep weights."""
    rng, rows = random.Random(5), []
    for k in range(400):
        y = k % 3
        slots = np.array(sorted({y, *(rng.randrange(10, 2000) for _ in range(20))}), np.int32)
        rows.append(language_id.Row(slots, np.full(len(slots), len(slots) ** -0.5, np.float32), y))
    w, b = language_id.train_ftrl(rows, 3)
    told = [int(np.argmax(r.values @ w[r.slots] + b)) for r in rows]
    assert told == [r.label for r in rows]
    assert [int(np.argmax(w[k])) for k in range(3)] == [0, 1, 2]
    assert np.abs(w[10:]).max() < np.abs(w[:3]).max() / 3


def test_proximal_step_solves_its_problem():
    """The closed form is the minimum of the penalised sums."""
    rng = np.random.default_rng(2)
    for z, n in zip(rng.normal(0, 0.1, 50), rng.uniform(0, 4, 50), strict=True):
        w = float(language_id.proximal(np.array(z), np.array(n)))
        strength = (language_id.BETA + math.sqrt(n)) / language_id.ALPHA + language_id.L2
        cost = lambda x: z * x + language_id.L1 * abs(x) + 0.5 * strength * x * x  # noqa: B023, E731
        assert all(cost(w) <= cost(w + d) + 1e-12 for d in (-1e-3, 1e-3, -0.1, 0.1))


def test_temperature_calibrates():
    """Logits three times too large get a temperature of about three."""
    rng = np.random.default_rng(4)
    true = rng.normal(0, 1.5, (4000, 4))
    p = language_id.softmax(true)
    labels = (p.cumsum(axis=1) > rng.random((4000, 1))).argmax(axis=1)
    assert abs(language_id.fit_temperature(3 * true, labels, np.ones(4)) - 3) < 0.4


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in Q["op11_language_id"](spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    assert set(rows) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [d for d, r in rows.items() if r.held_out]
    right = sum(rows[d].lang_pred == truth[d] for d in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    # The score is a probability: its mean is about the share that is right.
    assert abs(sum(rows[d].score for d in held) - right) < 0.04 * len(held)


def test_language_ignores_held_out_rows(spark, docs):
    """Labels and texts of held-out rows change nothing that was learned."""
    more = spark.createDataFrame([(d, "the house and the garden", "xx") for d in range(200) if zlib.crc32(str(d).encode()) % 4 == 2], "doc_id long, text string, lang string")
    base = docs.select("doc_id", "text", "lang")
    a, b = language_id.fit(base), language_id.fit(base.unionByName(more))
    assert a.languages == b.languages == ["de", "en"] and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_language_edges(spark, docs):
    more = [(d, ("das haus und der garten ", "the house and the garden ")[d % 2] * (1 + d % 3), ("de", "en")[d % 2]) for d in range(100, 160)]
    rows = language_id.language_id(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)).collect()
    assert len(rows) == len(ROWS) + 60
    got = {r.doc_id: r for r in rows}
    assert [(got[k].lang_pred, got[k].score) for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[9].lang_pred == "de" and got[5].lang_pred == "en" and got[None].held_out is False
    assert language_id.language_id(docs.where("false")).collect() == []
    nothing = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}


# Ranked lexical search


def ranked(docs, items, k=10):
    """Plain Python over all documents: (item number, rank, doc_id, score)."""
    found = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    bags = [(d, Counter(found(x))) for d, x in docs]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for i, text in enumerate(items):
        asked, scores = Counter(found(text)), []
        for d, c, n in bags:
            m = 100 - 75 + 75 * n * n_docs // n_words
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("block_chars", [lexical_search.BLOCK_CHARS, 3_000])
def test_search(spark, sf, block_chars):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    got = lexical_search.lexical_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), block_chars=block_chars)
    want = sorted((items[i][0], r, d, s) for i, r, d, s in ranked(docs, [t for _, t in items]))
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()) == want


def test_products_in_blocks(monkeypatch):
    """The accumulator's size changes nothing, however small."""
    rng = np.random.default_rng(6)
    items = lexical_search.Items([(k, " ".join(f"w{x}" for x in rng.integers(0, 40, 12))) for k in range(30)])
    sizes = rng.integers(0, 15, 50)
    term = np.concatenate([rng.permutation(len(items.vocabulary))[:n] for n in sizes]).astype(np.int64)
    impact = rng.integers(1, 2**40, len(term))
    dense = np.zeros((len(items.vocabulary), 30), np.int64)
    for t in range(len(items.vocabulary)):
        a, e = items.begin[t], items.begin[t + 1]
        dense[t, items.item[a:e]] = items.times[a:e]
    row = np.repeat(np.arange(50), sizes)
    want = np.stack([(impact[row == r, None] * dense[term[row == r]]).sum(axis=0) for r in range(50)])
    for cells in (1, 100, 1 << 20):
        monkeypatch.setattr(lexical_search, "CELLS", cells)
        got = np.concatenate([s for _, _, s in lexical_search.products(items, impact, term, np.cumsum(sizes))])
        assert (got == want).all()


def test_best_keeps_ties_by_id(monkeypatch):
    monkeypatch.setattr(lexical_search, "HELD", 50)
    rng = np.random.default_rng(9)
    best, scores = lexical_search.Best(4, 5), rng.integers(0, 6, (400, 4))
    doc = rng.permutation(400)
    for k in range(0, 400, 7):
        best.add(scores[k : k + 7], doc[k : k + 7], np.zeros(len(doc[k : k + 7]), bool))
    item, score, found, _ = best.reduce()
    for i in range(4):
        want = sorted((-s, d) for s, d in zip(scores[:, i].tolist(), doc.tolist(), strict=True) if s > 0)[:5]
        assert [(-s, d) for s, d in zip(score[item == i].tolist(), found[item == i].tolist(), strict=True)] == want


def test_search_edges(spark, docs):
    asked = [(1, "The HOUSE the"), (2, None), (3, ""), (4, "?!"), (5, "absent"), (6, "word"), (1, "The HOUSE the"), (None, "garten")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "score", "rank")})
    got = sorted(((r.item_id or 0, r.rank, r.doc_id, r.score) for r in lexical_search.lexical_search(docs, items).collect()), key=str)
    want = sorted(((asked[i][0] or 0, r, d, s) for i, r, d, s in ranked([r[:2] for r in ROWS], [t for _, t in asked])), key=str)
    assert got == want and [r[2] for r in got if r[0] == 0] == [9, None]
    assert lexical_search.lexical_search(docs.where("false"), items).collect() == []
    assert lexical_search.lexical_search(docs, items.where("false")).collect() == []


# Periodic runs


def brute_runs(w):
    """Every period from one on, islands of equal words so far apart."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                best.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    return b" ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def test_runs_of_random_words():
    rng, docs = random.Random(1), []
    for _ in range(1500):
        alphabet = rng.choice([1, 2, 2, 3, 5])
        w = [b"%d" % rng.randrange(alphabet) for _ in range(rng.choice([0, 1, 3, 6, 8, 20, 50, 90]))]
        for _ in range(rng.randrange(3)):
            a = rng.randint(0, len(w))
            w[a:a] = [b"%d" % rng.randrange(alphabet) for _ in range(rng.randint(1, 1 + len(w) // 4))] * rng.randint(2, 6)
        docs.append(w)
    got = periodic_runs.runs_of(docs)
    assert got == [brute_runs(w) for w in docs] and sum(map(len, got)) > 500
    assert all(periodic_runs.collapsed(w, r) == brute_collapsed(w, r) for w, r in zip(docs, got, strict=True))


def test_runs_in_small_grids(monkeypatch):
    monkeypatch.setattr(periodic_runs, "GRID", 7)
    docs = [[b"a", b"b"] * 20 + [b"c"] * 9 + [b"x", b"y", b"z"] * 4, [b"a"] * 5, [b"q"] * 6]
    assert periodic_runs.runs_of(docs) == [[(0, 40, 2), (40, 9, 1), (49, 12, 3)], [], [(0, 6, 1)]]


def test_planted_tail():
    words = [b"%d" % i for i in range(101)]
    changed = 0
    for d in range(300):
        h = zlib.crc32(str(d).encode())
        a, got = (h // 10) % 101, periodic_runs.repeated_tail(d, words)
        p = 1 + (101 - a) // (3 + (h // 10) % 8)
        assert got == ([words[i if i < a else a + (i - a) % p] for i in range(101)] if h % 10 == 0 else words)
        changed += got != words
    assert changed > 15 and periodic_runs.repeated_tail(None, words) is words


def test_run_digests(spark, sf):
    want = {}
    for r in table(spark, sf, "documents").collect():
        w = periodic_runs.repeated_tail(r.doc_id, (r.text or "").encode().split())
        if len(w) > 1500:
            continue
        runs = brute_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[r.doc_id] = (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_collapsed(w, runs)).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in Q["op13_periodic_runs"](spark, sf).collect()}
    assert {d: got[d] for d in want} == want and sum(v[0] > 0 for v in want.values()) > 10


def test_runs_edges(docs):
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert all(got[k].runs == [] and got[k].text == "" for k in (1, 2)) and got[3].text == "12 !"
    assert [tuple(x) for x in got[6].runs] == [(0, 30_000, 1)] and got[6].text == "word"
    assert got[None].text == "das haus und der garten" and got[7].text == "naïve ßtraße 日本語 das haus"
    empty = hashlib.sha256(b"").hexdigest()
    digest = {r.doc_id: r for r in periodic_runs.run_digests(periodic_runs.periodic_runs(docs)).collect()}
    assert tuple(digest[1])[1:] == (0, None, None, None, None, empty, empty)
    assert periodic_runs.periodic_runs(docs.where("false")).collect() == []
