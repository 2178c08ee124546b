"""Every operator on nulls, empty and long texts, ties, repeats and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchgrid.llm import decontamination, html_extraction, license_scan, line_dedup, packing, quality_rules
from matchgrid.llm import simhash, suffix_dedup, toxicity, warc
from matchgrid.llm.queries import tokenizer_path

LINE = "a line that is long enough to take part, number {}"
ROWS = [
    (1, None, "x"),
    (2, "", "x"),
    (3, " \n\t ", "x"),
    (4, "short", "x"),
    (5, LINE.format(1) + "\n" + LINE.format(2), "x"),
    (5, LINE.format(1) + "\n" + LINE.format(2), "x"),
    (6, "word " * 30_000, "x"),
    (None, "no id here", "x"),
    (7, "naïve ßtraße 日本語 <|endoftext|> " * 3, "x"),
    (8, LINE.format(1) + "\n" + LINE.format(22), "x"),
]
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["h", "fp", "k", "pos", "key", "file", "block", "toxic", "n", "u", "v", "root", "removed", "line"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0, 1), (5, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, LINE.format(1) + " " + LINE.format(2)), (2, None), (3, ""), (4, "日本語"), (4, "日本語")]
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(docs, labels, benchmark):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *CLASH)
    return {
        "pack": lambda: packing.pack(docs, tokenizer_path()),
        "toxicity": lambda: toxicity.toxicity(docs, labels),
        "license": lambda: license_scan.license_scan(docs),
        "line_dedup": lambda: line_dedup.line_dedup(docs),
        "warc": lambda: warc.warc_round_trip(pages),
        "quality": lambda: quality_rules.quality_rules(docs, labels),
        "decontamination": lambda: decontamination.decontamination(docs, benchmark),
        "suffix": lambda: suffix_dedup.suffix_dedup(docs),
        "html": lambda: html_extraction.html_extraction(pages),
        "simhash": lambda: simhash.simhash_components(docs),
    }


NAMES = ["pack", "toxicity", "license", "line_dedup", "warc", "quality", "decontamination", "suffix", "html", "simhash"]


@pytest.mark.parametrize("name", NAMES)
def test_rows(docs, labels, benchmark, name):
    rows = operators(docs, labels, benchmark)[name]().collect()
    if name == "decontamination":
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(5, 1), (5, 1), (7, 4), (7, 4), (8, 1)]
    elif name == "pack":
        assert len({(r.doc_id, r.piece) for r in rows}) == len(ROWS) - 1 + sum(r.piece > 0 for r in rows)
    else:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, benchmark, name):
    assert operators(docs.where("false"), labels, benchmark)[name]().collect() == []


def test_values(docs, labels, benchmark):
    ops = operators(docs, labels, benchmark)
    fp = {r.doc_id: r for r in ops["simhash"]().collect()}
    assert fp[1].fingerprint == fp[2].fingerprint == fp[3].fingerprint == "0" * 16
    assert fp[3].component_id == 1
    cut = {r.doc_id: r for r in ops["suffix"]().collect()}
    assert cut[1].n_bytes == cut[2].n_bytes == 0 and cut[6].n_removed == cut[6].n_bytes == 150_000
    scanned = {r.doc_id: r for r in ops["license"]().collect()}
    assert all((scanned[k].n_words, scanned[k].n_base, scanned[k].labels, scanned[k].score, scanned[k].first_word) == (0, 0, "", 0.0, None) for k in (1, 2, 3))
    assert scanned[6].n_words == 30_000 and scanned[None].n_words == 3
    main = {r.page_id: r for r in ops["html"]().collect()}
    assert [(main[k].text, main[k].n_chars) for k in (1, 2, 3, 4)] == [("", 0)] * 3 + [("short", 5)]
    assert main[6].n_chars == 149_999 and main[None].text == "no id here"
    records = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in ops["warc"]().collect())
    assert records[:3] == [(-1, 10, "response", None), (1, 0, "revisit", 2), (2, 0, "response", None)]
    assert [r[2] for r in records if r[0] == 5] == ["response"] * 2
    # Two labels tell nothing apart.
    assert all(r.score < 1e-9 and r.predicted == 0 for r in ops["toxicity"]().collect())
    kept = {r.doc_id: r for r in ops["quality"]().collect()}
    assert kept[1].base_failed and kept[6].base_failed and kept[6].n_repeat_words == 30_000
    lines = ops["line_dedup"]().collect()
    assert {c for c in CLASH} <= set(lines[0].asDict())
    assert [r.text for r in lines if r.doc_id == 8] == [""]
    assert [r.n_removed for r in lines if r.doc_id == 5] == [1, 1]  # its lines are one edit apart
    assert [r.text for r in lines if r.doc_id == 1] == [None]


@pytest.mark.parametrize("step", [k for k, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, docs, labels, benchmark, step, monkeypatch):
    tables = {"labels": labels, "benchmark": benchmark, "documents": docs}
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: tables[n])
    out = dict(corpus_pipeline.STAGES)[step](spark, docs, "none")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} >= {4, None}


def test_pipeline_on_empty_tables(spark, docs, labels, benchmark, monkeypatch):
    tables = {"labels": labels.where("false"), "benchmark": benchmark.where("false"), "documents": docs.where("false")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda s, d, n: tables[n])
    assert corpus_pipeline.run(spark, "none").collect() == []
