"""Answers of a model as a durable table: each prompt is asked once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from matchgrid.session import partitions_of, written
from matchgrid.sources.labels import ask_model

SCHEMA = "hash string, model string, answer string, part string"
#: Hashes (64 bytes each) that are broadcast to look answers up, at most.
BROADCAST_HASHES = 1_000_000


def stored(spark: SparkSession, store: str) -> DataFrame:
    """All answers of a store, which need not exist yet."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(store)
    except AnalysisException:
        rows = spark.createDataFrame([], SCHEMA)
    return rows


def asked_once(
    prompts: DataFrame, store: str, make_client: Callable[[], Callable[[str], str]], model: str = "", most_chars: int | None = None, turns: int = 1,
) -> DataFrame:
    """``key, answer, error`` of prompts ``key, prompt``; only prompts without an answer in the store are asked.

    An answer belongs to the model's name and the whole prompt, by their SHA-256; equal
    prompts are asked once. New answers are written before any is used, in ``turns``
    parts by hash, so that a job that fails loses one part at most. What fails is not stored, has its
    error, and is asked again the next time. A null prompt has no answer. The store is a
    Parquet folder by first digit of the hash; two jobs that ask the same at the same time may both write an
    answer, of which the first by text counts.
    """
    spark = prompts.sparkSession
    hashed = prompts.select("key", "prompt", F.sha2(F.concat(F.lit(model), F.lit("\x00"), "prompt"), 256).alias("hash"))
    hashed = written(hashed.withColumn("part", F.substring("hash", 1, 1)), "prompts")
    # Steps by hash run in as many partitions as there are prompts for, whatever the session's number.
    n = partitions_of(hashed)
    wanted = written(hashed.where("hash IS NOT NULL").repartition(n, "hash").groupBy("hash", "part").agg(F.min("prompt").alias("prompt")), "wanted")
    names = wanted.select("hash", "part")
    few = F.broadcast(names) if names.count() <= BROADCAST_HASHES else names
    have = stored(spark, store).join(few, ["part", "hash"], "left_semi").groupBy("hash").agg(F.min("answer").alias("answer"))
    have = written(have, "answers")
    missing = (wanted if have.isEmpty() else wanted.repartition(n, "hash")).join(have, "hash", "left_anti")
    known = have.withColumn("error", F.lit(None).cast("string"))
    for turn in range(turns):
        ask = missing.where(F.pmod(F.xxhash64("hash"), F.lit(turns)) == turn)
        fresh = written(ask_model(ask.select(F.col("hash").alias("key"), "prompt"), make_client, most_chars).withColumnRenamed("key", "hash"), "fresh")
        good = fresh.where("error IS NULL AND answer IS NOT NULL")
        good.select("hash", F.lit(model).alias("model"), "answer", F.substring("hash", 1, 1).alias("part")).repartition("part").write.mode("append").partitionBy("part").parquet(store)
        known = known.unionByName(fresh.select("hash", "answer", "error"))
    return hashed.repartition(n, "hash").join(known, "hash", "left").select("key", "answer", "error")
