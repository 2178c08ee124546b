"""Corpus pipeline: five stages over ``documents``, each on what its predecessor kept.

Toxic documents go, repeated lines go (and documents that consist of nothing
else), one document of each SimHash group and of each group of near copies stays, documents that hold a
benchmark item go, and the rest is packed into sequences. Every stage but the
last returns the columns of ``documents``.

Edge cases: a row without text has no line and no shingle; one of all rows
without any word stays, as they are equal texts. Rows without an id take
part everywhere, and come last where the smallest id decides. Rows that repeat id
and text become one row in the third stage. Of near copies of equal ids the one
of the smaller text hash stays. Texts of any length are taken whole. Columns that
``documents`` has besides come through unchanged up to the last stage. Without
labels no document is toxic, without benchmark items none is contaminated;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchgrid.llm import decontamination, line_dedup, packing, simhash, toxicity
from matchgrid.llm.common import materialize, table
from matchgrid.llm.queries import tokenizer_path

#: SQL cannot express the classifier or the packing; tests use brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned on all labelled rows of the learning folds; scores only ``docs``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again; a stage's table goes when the next is written."""
    docs, written = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", instead_of=written)
        written = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
