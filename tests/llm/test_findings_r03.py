"""Findings of round r03 on training-data operators."""

import gc


def test_encoder_runs_without_pythons_collector():
    import tokenizers

    from matchgrid.llm.packing import Encoder
    from matchgrid.llm.queries import tokenizer_path

    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}wort{'.' * (j % 3)}" for j in range(300)) for i in range(200)]
    encode, runs = Encoder(tokenizer_path()), []
    told = lambda phase, info: runs.append(phase)
    assert gc.isenabled()
    gc.collect()
    gc.callbacks.append(told)
    try:
        got = encode(texts)
        during = len(runs)
    finally:
        gc.callbacks.remove(told)
    assert not during and gc.isenabled()
    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    assert got[:20] == [b"".join(x.to_bytes(4, "little") for x in whole.encode(t, add_special_tokens=False).ids) for t in texts[:20]]


def test_a_written_step_leaves_no_garbage_on_the_driver(spark):
    from matchgrid.llm.common import materialize

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    runs = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())
    before = runs()
    assert materialize(spark.range(3), "garbage").count() == 3
    assert runs() > before


def test_lines_one_word_or_one_character_apart_in_one_search(spark):
    from matchgrid.llm.line_dedup import lines_of, near_lines

    long = [f"word{k}" for k in range(12)]
    texts = {
        1: " ".join(long), 2: " ".join([*long[:5], "other", *long[6:]]), 3: " ".join([*long, "behind"]), 4: " ".join(["before", *long]),
        5: "a line of characters", 6: "a line of charakters", 7: "a line of characterss", 8: "another  line with  gaps, of ten words and some  more",
        9: "another  line with  gaps, of ten other and some  more", 10: "nothing like it, whatever one does", 11: "a line of other words",
    }
    lines = lines_of(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    names = {r.id: r.doc_id for r in lines.collect()}
    found = {tuple(sorted((names[r.u], names[r.v]))) for r in near_lines(lines).collect()}
    near = {(1, 2), (1, 3), (1, 4), (5, 6), (5, 7), (8, 9)}
    assert found <= near | {(2, 3), (2, 4), (3, 4), (6, 7)} and len(found & near) >= 4
    groups = [{1, 2, 3, 4}, {5, 6, 7}, {8, 9}]
    for g in groups:
        reached = {min(g)}
        for _ in g:
            reached |= {x for pair in found if reached & set(pair) for x in pair}
        assert reached == g


def _edited(rng, line):
    """The line with one character or, if it has ten words and more, one word replaced, inserted or removed."""
    units, other = (list(line), "x y") if len(line.split(" ")) < 10 or rng.random() < 0.7 else (line.split(" "), ["other", "word"])
    glue = "" if isinstance(other, str) else " "
    at, kind = rng.choice([0, len(units) - 1, rng.randrange(len(units))]), rng.randrange(3)
    units[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(other)]
    return glue.join(units).strip(" ")


def test_lines_meet_by_few_keys(spark):
    import random

    from pyspark.sql import functions as F

    from matchgrid.llm.line_dedup import _halves, lines_of, meeting_lines

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl\u00e4\u4e2d") for _ in range(rng.randint(1, 7)))
    pairs = []
    for n in [1, 2, 5, 8, 9, 9, 9, 10, 10, 11, 12, 13, 16, 17, 24, 25, 33, 64, 65] * 20:
        line = " ".join(word() for _ in range(n))
        line += "".join(rng.choice("mnopq") for _ in range(max(0, rng.choice([17, 18, 20, 21, 24]) - len(line))))
        other = _edited(rng, line)
        if other != line and min(len(other), len(line)) >= 16:
            pairs.append((line, other))
    assert len(pairs) > 300
    alone = [" ".join(word() for _ in range(rng.randint(12, 80))) for _ in range(300)]
    rows = [(k, x) for k, p in enumerate(pairs) for x in p] + [(10_000 + k, x) for k, x in enumerate(alone)] + [(20_000, "twice"), (20_001, "twice")]
    lines = lines_of(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = _halves(lines).join(lines.select("id", "doc_id"), "id").groupBy("doc_id").agg(F.collect_list("key").alias("keys")).collect()
    keys = {r.doc_id: r["keys"] for r in keys}
    assert all(len(set(keys[k])) < len(keys[k]) for k in range(len(pairs)))
    assert sum(len(keys[10_000 + k]) for k in range(300)) < 3 * 300  # before: eight a line
    met = meeting_lines(lines).collect()
    assert {r.doc_id for r in met} == {*range(len(pairs)), 20_000, 20_001}
    assert sorted(r.line for r in met if r.line) == sorted(x for p in pairs for x in p)


def test_lines_meet_by_shuffles_beyond_the_bounds(spark, monkeypatch):
    from matchgrid.llm import common, line_dedup

    near = "a line that is long enough to take part, number {}"
    rows = [(k, f"{near.format(k % 7)}\nthe same\nown text of the document {k * 7919}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    want = run()
    assert want[0] == rows[0][1] and want[399] == f"own text of the document {399 * 7919}"
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert run() == want


def test_a_later_step_frees_the_encoders_of_reused_workers(spark):
    from matchgrid.llm.common import map_arrow, worker_cache

    def look(batches):
        import os

        import pyarrow as pa

        for b in batches:
            before = len(worker_cache())
            worker_cache()[0] = bytes(1000)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * n), pa.array([before] * n), pa.array([n] * n)], ["pid", "held", "rows"])

    def seen(texts, cached):
        return map_arrow(texts, look, "pid long, held long, rows long", cached=cached).collect()

    texts = spark.range(0, 32, 1, 32).selectExpr("cast(id as string) as text")
    filled = seen(texts, True)
    freed = seen(texts, False)
    assert any(r.held for r in filled) and not any(r.held for r in freed)
    assert {r.pid for r in filled} & {r.pid for r in freed}


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from matchgrid.llm.common import SENT_BYTES, map_arrow

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    got = map_arrow(long, sizes, "n long, size long", batch_rows=1000).collect()
    assert sum(r.n for r in got) == 60
    assert max(r.size for r in got) <= SENT_BYTES + 2_000_000


def test_both_readings_of_a_tokenizer_share_its_model():
    from matchgrid.llm.packing import Encoder
    from matchgrid.llm.queries import tokenizer_path

    encode = Encoder(tokenizer_path())
    before = encode.words.get_vocab_size()
    encode.tokenizer.model.dropout = 0.5
    try:
        assert encode.words.model.dropout == 0.5
    finally:
        encode.tokenizer.model.dropout = None
    assert before == encode.words.get_vocab_size() and encode.words.normalizer is None
