"""Training of the stroke classifier from labelled hits: cross-validation, unseen videos, the model and its report."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators import learning, report
from matchgrid.sources.stores import save_model

#: Rows that a class, and a video held out, need.
MIN_PER_CLASS, MIN_HELD_OUT = 4, 30


def usable(samples: DataFrame) -> tuple[DataFrame, list[str]]:
    """Samples of the classes that have enough, and these classes in order."""
    counts = samples.groupBy("truth").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PER_CLASS)
    # A row for each class: a short list.
    classes = sorted(r.truth for r in counts.select("truth").collect())
    return samples.where(F.col("truth").isin(classes)), classes


def unseen_videos(samples: DataFrame, classes: list[str]) -> DataFrame:
    """Predictions of each video by a classifier that was fitted on the others; small videos are not held out."""
    sizes = samples.groupBy("video").agg(F.count("*").alias("n"))
    # Videos with labels are few: people watched them.
    numbered = sizes.where(F.col("n") >= MIN_HELD_OUT).withColumn("fold", F.row_number().over(Window.orderBy("video")) - 1)
    k = numbered.count()
    if not k:
        return samples.select("key", "truth", F.lit(None).cast("string").alias("pred"), F.lit(None).cast("double").alias("prob"), "video").where("false")
    rows = samples.join(numbered.select("video", "fold"), "video", "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))
    rows = rows.withColumn("key", F.concat_ws("/", "video", "key"))
    out = learning.cross_validate(rows.select(F.xxhash64("key").alias("key"), "truth", "fold", "features"), classes, k)
    return out.join(rows.select(F.xxhash64("key").alias("key"), "video"), "key")


def train(samples: DataFrame, path: str | None = None, most_folds: int = 5) -> dict:
    """Cross-validates, fits on all samples and saves the model; returns predictions and the report's tables.

    samples: ``video, key, features, truth, stroke_vlm, stroke_pose`` (merged classes).
    """
    spark = samples.sparkSession
    rows, classes = usable(samples)
    rows = rows.withColumn("id", F.xxhash64("video", "key"))
    total = rows.count()
    if len(classes) < 2 or total < 10:
        raise ValueError(f"too few labels: {total} rows of {len(classes)} classes")
    folded = learning.folds(rows.withColumns({"own": F.col("key"), "key": F.col("id")}), most_folds)
    out = learning.cross_validate(folded.select("key", "truth", "fold", "features"), classes, most_folds)
    judged = folded.select("key", "video", "own", "stroke_vlm", "stroke_pose").join(out, "key")
    accuracy = learning.accuracy(judged, "pred", "stroke_vlm", "stroke_pose")
    by_answer = {r.answer: r for r in accuracy.collect()}
    bounded = rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(learning.MAX_LABELLED).select("features", "truth").toPandas()
    x, y = np.stack(bounded["features"].to_numpy()).astype(float), bounded["truth"].map(classes.index).to_numpy()
    model = learning.fit_mlp(x, y, len(classes))
    vlm = by_answer["stroke_vlm"]
    meta = {"classes": classes, "n": total, "cv_accuracy": by_answer["pred"].accuracy, "vlm_accuracy": vlm.accuracy if vlm.n else None}
    if path is not None:
        save_model(spark, model, meta, path)
    unseen = unseen_videos(rows, classes)
    held = learning.held_out(unseen, "pas_une_frappe", MIN_HELD_OUT)
    confusion = report.confusion_table(learning.confusion(judged, classes), classes)
    return {"model": model, "meta": meta, "predictions": judged, "accuracy": accuracy, "held_out": held, "confusion": confusion}


def training_report(result: dict) -> str:
    """The report of a training as Markdown: short lists of classes, methods and videos."""
    meta = result["meta"]
    lines = ["# Stroke classifier", "", f"{meta['n']} labelled hits of {len(meta['classes'])} classes.", "", "| Method | Accuracy on the same hits |", "|---|---|"]
    lines += [r.line for r in report.accuracy_lines(result["accuracy"]).orderBy("answer").collect()]
    lines += ["", "| Unseen video | Hits | Accuracy | False hits rejected | Real hits lost |", "|---|---|---|---|---|"]
    lines += [
        f"| {r.video} | {r.n} | {100 * r.accuracy:.0f} % | {r.false_rejected}/{r.false_hits} | {r.real_lost}/{r.real_hits} |"
        for r in result["held_out"].orderBy("video").collect()
    ]
    lines += ["", "Confusion in cross-validation:", "", *[r.line for r in result["confusion"].orderBy("pos").collect()]]
    return "\n".join(lines) + "\n"
