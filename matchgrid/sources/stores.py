"""Stores of a labelling and training loop: labels, hits, tracks, features and models as tables with versions.

Every store is a folder of Parquet partitioned by its key, on any file system
that Spark can write. A write replaces the partitions it holds and no others,
so runs of different videos do not disturb each other.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.functions.scalars import merged_class
from matchgrid.operators.hits import FEATURE_VERSION
from matchgrid.session import ensure_checkpoint_dir

KEY = ["video", "key"]


def _put(rows: DataFrame, path: str, *by: str) -> None:
    rows.repartition(*by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_labels(labels: DataFrame, path: str) -> None:
    """``video, key, label, annotator`` as the labels of their videos."""
    _put(labels.select(*KEY, "label", "annotator"), path, "video")


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """All saved labels; none where nothing was saved."""
    schema = "key string, label string, annotator string, video string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def labelled_videos(labels: DataFrame) -> DataFrame:
    return labels.select("video").distinct()


def import_labels(saved: DataFrame, fresh: DataFrame, known: DataFrame, annotator: str = "user") -> DataFrame:
    """Saved labels with the fresh ones over them, under the annotator's name; unknown labels are not taken."""
    new = fresh.join(known.select("label").distinct(), "label", "left_semi").select(*KEY, F.col("label").alias("n"))
    both = saved.join(new.withColumn("a", F.lit(annotator)), KEY, "full")
    return both.select(*KEY, F.coalesce("n", "label").alias("label"), F.coalesce("a", "annotator").alias("annotator"))


def save_hits(hits: DataFrame, path: str, checked: bool) -> None:
    """Hits of videos, ``checked`` by a model or as measured."""
    _put(hits.withColumn("checked", F.lit(checked)), path, "video", "checked")


def load_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of every video: those a model checked where there are any, else the measured ones."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no hits in {path}: analyse the videos first")
    hits = spark.read.parquet(path)
    best = hits.groupBy("video").agg(F.max("checked").alias("checked"))
    return hits.join(best, ["video", "checked"], "left_semi").drop("checked")


def save_tracks(tracks: DataFrame, path: str) -> None:
    """Tracks with their rate ``fps``."""
    _put(tracks, path, "video")


def load_tracks(tracks: DataFrame, hits: DataFrame, fps: float) -> tuple[DataFrame, DataFrame]:
    """Tracks of the wanted rate, and the hits of their videos: frames of hits on tracks of another rate mean nothing."""
    fresh = tracks.where(F.abs(F.col("fps") - fps) <= 0.01)
    stale = tracks.where(F.abs(F.col("fps") - fps) > 0.01).select("video").distinct()
    return fresh, hits.join(stale, "video", "left_anti")


def save_features(features: DataFrame, path: str, fps: float, version: int = FEATURE_VERSION) -> None:
    """``video, key, features, stroke_vlm, stroke_pose`` with version and rate, over what was saved of the same hits.

    Features of hits that are not given stay: a new analysis may cut shots
    anew and so rename hits that were labelled before.
    """
    spark = features.sparkSession
    rows = features.select(*KEY, "features", "stroke_vlm", "stroke_pose").withColumns({"version": F.lit(version), "fps": F.lit(fps)})
    if _exists(spark, path):
        old = spark.read.parquet(path).join(rows.select("video").distinct(), "video", "left_semi")
        old = old.where((F.col("version") == version) & (F.abs(F.col("fps") - fps) <= 0.01))
        rows = rows.unionByName(old.join(rows.select(*KEY), KEY, "left_anti"))
        # Read before the partitions are replaced.
        ensure_checkpoint_dir(spark)
        rows = rows.checkpoint()
    _put(rows, path, "video")


def load_features(spark: SparkSession, path: str, version: int = FEATURE_VERSION) -> DataFrame:
    """Saved features of the wanted version; none where nothing was saved."""
    schema = "key string, features array<float>, stroke_vlm string, stroke_pose string, version int, fps double, video string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("version") == version)


def collect_samples(features: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples ``video, key, features, truth, stroke_vlm, stroke_pose`` of labelled hits, and the
    videos whose labels have no features at all, with their number of labels."""
    rows = features.join(labels.select(*KEY, merged_class("label").alias("truth")), KEY).where("truth is not null")
    missing = labels.join(features.select("video").distinct(), "video", "left_anti").groupBy("video").agg(F.count("*").alias("n_labels"))
    return rows.select(*KEY, "features", "truth", "stroke_vlm", "stroke_pose"), missing


def save_model(spark: SparkSession, model: dict, meta: dict, path: str, version: int = FEATURE_VERSION) -> None:
    """A fitted classifier with its facts, as one row; earlier models stay and can be loaded by number."""
    number = spark.read.parquet(path).agg(F.max("number")).first()[0] + 1 if _exists(spark, path) else 0
    layers = [{"shape": list(p.shape), "values": p.ravel().tolist()} for p in [*model["p"], model["mu"], model["sd"]]]
    row = [(number, version, json.dumps(meta, default=float), json.dumps(layers))]
    spark.createDataFrame(row, "number int, version int, meta string, layers string").coalesce(1).write.mode("append").parquet(path)


def load_model(spark: SparkSession, path: str, number: int | None = None, version: int = FEATURE_VERSION) -> tuple[dict, dict] | None:
    """The last model, or that of a number, and its facts; None where there is none for the features' version."""
    if not _exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    row = (rows if number is None else rows.where(F.col("number") == number)).orderBy(F.desc("number")).first()
    if row is None or row.version != version:
        return None
    *p, mu, sd = (np.array(x["values"]).reshape(x["shape"]) for x in json.loads(row.layers))
    return {"p": p, "mu": mu, "sd": sd}, json.loads(row.meta)


def classifier_beats_model(meta: dict | None) -> bool:
    """Whether a classifier's cross-validated accuracy is that of the vision model on the same hits, or better.

    Without a measurement of the model any classifier is; without a classifier none is.
    """
    if meta is None:
        return False
    other = meta.get("vlm_accuracy")
    return meta["cv_accuracy"] >= (0.0 if other is None or other != other else other)


def memo(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; made and written first where it is not there."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def existing_images(spark: SparkSession, items: DataFrame, folder: str) -> DataFrame:
    """Items ``key`` that have an impact picture in the folder, with its path; files are listed, not read."""
    if not _exists(spark, folder):
        return items.withColumn("image", F.lit(None).cast("string")).where("false")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_impact.jpg").load(folder).select("path")
    named = files.select(F.col("path").alias("image"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), "_impact\\.jpg$", "").alias("file"))
    return items.withColumn("file", F.replace("key", F.lit(":"), F.lit("_"))).join(named, "file").drop("file")
