"""Label files, video keys and model answers as tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``video, shot_id, frame, slot, label, annotator`` from label files.

    A file maps ``shot:frame:slot`` to a label; the video is part of the key
    here, since the same hit key occurs in several videos.
    """
    schema = "video string, key string, labels map<string, struct<label string, annotator string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    out = rows.select("key", F.explode("labels").alias("hit", "l"))
    part = F.split("hit", ":")
    return out.select(
        F.col("key").alias("video"), part[0].cast("int").alias("shot_id"), part[1].cast("int").alias("frame"),
        part[2].cast("int").alias("slot"), "l.label", "l.annotator",
    )


def video_keys(spark: SparkSession, path: str) -> DataFrame:
    """``path, video_key``: stem and hash of name, size, first and last MiB of each file.

    Files are listed by Spark without their contents; tasks read the two ends
    only, through pyarrow's file systems, so length does not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for p, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(p)
                name = unquote(p).rsplit("/", 1)[-1]
                h = hashlib.sha1(f"{name}:{size}".encode())
                with store.open_input_file(place) as f:
                    h.update(f.read_at(min(size, MIB), 0))
                    if size > 2 * MIB:
                        h.update(f.read_at(MIB, size - MIB))
                keys.append(f"{name.rsplit('.', 1)[0] if '.' in name[1:] else name}-{h.hexdigest()[:12]}")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(keys, pa.string())], ["path", "video_key"])

    return spark.read.format("binaryFile").load(path).select("path", "length").mapInArrow(run, "path string, video_key string")


def probe(spark: SparkSession, path: str) -> DataFrame:
    """Stream facts from probe reports (JSON): picture size after rotation, rate, sound, HDR."""
    schema = (
        "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, pix_fmt: string,"
        " width: int, height: int, duration: string, avg_frame_rate: string, r_frame_rate: string, color_transfer: string,"
        " disposition: struct<attached_pic: int>, side_data_list: array<struct<rotation: int>>>>"
    )
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    pictures = F.filter("streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0))
    rows = rows.withColumn("v", F.get(pictures, F.lit(0))).where("v is not null")
    rows = rows.withColumn("rotation", F.coalesce(F.get(F.filter("v.side_data_list", lambda x: x["rotation"].isNotNull()), F.lit(0))["rotation"], F.lit(0)))
    turned = F.pmod(F.col("rotation"), F.lit(180)) != 0
    rate = lambda c: F.expr(f"try_divide(try_cast(split({c}, '/')[0] as double), try_cast(get(split({c}, '/'), 1) as double))")
    number = lambda c: F.expr(f"case when try_cast({c} as double) > 0 and not isnan(try_cast({c} as double)) then try_cast({c} as double) end")
    return rows.select(
        "file", F.coalesce(number("format.duration"), number("v.duration")).alias("duration"),
        F.when(turned, F.col("v.height")).otherwise(F.col("v.width")).alias("width"),
        F.when(turned, F.col("v.width")).otherwise(F.col("v.height")).alias("height"),
        F.coalesce(F.nullif(rate("v.avg_frame_rate"), F.lit(0.0)), rate("v.r_frame_rate")).alias("native_fps"),
        F.exists("streams", lambda s: s["codec_type"] == "audio").alias("has_audio"), "rotation",
        F.col("v.pix_fmt").alias("pix_fmt"), F.col("v.codec_name").alias("codec"),
        F.coalesce(F.col("v.color_transfer").isin("smpte2084", "arib-std-b67"), F.lit(False)).alias("hdr"),
    )


def ask_model(prompts: DataFrame, make_client: Callable[[], Callable[[str], str]], most_chars: int | None = None) -> DataFrame:
    """``key, prompt`` to ``key, answer, error``: one client for each task, prompts in Arrow batches.

    A client with a method ``many`` gets a batch at once. A prompt over
    ``most_chars``, the client's context, is not asked; what fails has its
    error, and does not end the job.
    """

    def one(ask: Callable[[str], str], prompt: str) -> tuple[str | None, str | None]:
        try:
            return ask(prompt), None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_client()
        for pdf in batches:
            long = [most_chars is not None and len(p) > most_chars for p in pdf["prompt"]]
            short = [p for p, x in zip(pdf["prompt"], long, strict=True) if not x]
            try:
                got = [(a, None) for a in ask.many(short)] if hasattr(ask, "many") else [one(ask, p) for p in short]
            except Exception:  # noqa: BLE001
                got = [one(ask, p) for p in short]
            answers = iter(got)
            rows = [(None, "prompt too long") if x else next(answers) for x in long]
            yield pd.DataFrame({"key": pdf["key"], "answer": [a for a, _ in rows], "error": [e for _, e in rows]})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, answer string, error string")
