"""Sound and pictures as tables: WAV files, raw frames, crops and colours. Decoding of codecs is left to other tools."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.sources.frames import wave_of

def wav_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``path, rate, channels, duration`` from the headers of WAV files, of which nothing else is read; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wave_of(p, size) for p, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True)]
            cols = [pa.array([w and getattr(w, c) for w in found], k) for c, k in (("rate", pa.int32()), ("channels", pa.int32()), ("duration", pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("path"), *cols], ["path", "rate", "channels", "duration"])

    # Without their content the files are only listed.
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(run, "path string, rate int, channels int, duration double")


def wav_sounds(spark: SparkSession, path: str) -> DataFrame:
    """``path, rate, samples``: each file as one channel of floats, the mean of its channels.

    One sound is one row: a shot's sound, some seconds long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rates, samples = [], []
            for content in b.column("content").to_pylist():
                with wave.open(io.BytesIO(content)) as w:
                    kind = {1: "u1", 2: "<i2", 4: "<i4"}[w.getsampwidth()]
                    x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(np.float32).reshape(-1, w.getnchannels()).mean(axis=1)
                    rates.append(float(w.getframerate()))
                    samples.append((x - 128) / 128 if kind == "u1" else x / np.float32(2 ** (8 * w.getsampwidth() - 1)))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(rates, pa.float64()), pa.array(samples, pa.list_(pa.float32()))], ["path", "rate", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rate double, samples array<float>")


def crops(frames: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """``key, frame, w, h, pixels``: the part of each frame inside each of its boxes ``key, frame, x0, y0, x1, y1``.

    Boxes are cut at the picture's edges; empty ones give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                x0, y0, x1, y1 = max(0, r["x0"]), max(0, r["y0"]), min(width, r["x1"]), min(height, r["y1"])
                if x1 > x0 and y1 > y0:
                    part = np.frombuffer(r["pixels"], np.uint8).reshape(height, width, 3)[y0:y1, x0:x1]
                    out.append((r["key"], r["frame"], x1 - x0, y1 - y0, part.tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "frame", "w", "h", "pixels"])

    both = frames.join(boxes.selectExpr("cast(key AS string) AS key", "frame", *[f"cast({c} AS int) AS {c}" for c in ("x0", "y0", "x1", "y1")]), "frame")
    return both.mapInArrow(run, "key string, frame long, w int, h int, pixels binary")


def torso_boxes(poses: DataFrame) -> DataFrame:
    """Boxes of the inner three fifths between shoulders and hips, of poses ``key, frame, kpts`` where all four are sure."""
    four = F.array(*[F.get("kpts", F.lit(k)) for k in (5, 6, 12, 11)])
    p = poses.withColumn("q", four).where(F.forall("q", lambda k: k["c"] >= 0.4))
    low = lambda c: F.floor(F.array_min(F.transform("q", lambda k: k[c]))).cast("int")
    high = lambda c: F.floor(F.array_max(F.transform("q", lambda k: k[c]))).cast("int")
    p = p.select("key", "frame", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
    p = p.withColumns({"dx": F.expr("(x1 - x0) div 5"), "dy": F.expr("(y1 - y0) div 5")})
    return p.selectExpr("key", "frame", "greatest(0, x0 + dx) AS x0", "greatest(0, y0 + dy) AS y0", "x1 - dx AS x1", "y1 - dy AS y1")


def mean_colours(parts: DataFrame, least: int = 30) -> DataFrame:
    """``key, frame, r, g, b``: mean colour of each crop of enough values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rgb = [np.frombuffer(x, np.uint8).reshape(-1, 3).mean(axis=0) for x in b.column("pixels").to_pylist()]
            cols = np.array(rgb).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("frame"), *[pa.array(cols[:, i]) for i in range(3)]], ["key", "frame", "r", "g", "b"])

    kept = parts.where(F.octet_length("pixels") >= least).select("key", "frame", "pixels")
    return kept.mapInArrow(run, "key string, frame long, r double, g double, b double")
