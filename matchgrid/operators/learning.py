"""Labels, evaluation, selection for annotation, folds and a small classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.scalars import merged_class

KEY = ["video", "key"]


def upsert_labels(saved: DataFrame, fresh: DataFrame, known: DataFrame) -> DataFrame:
    """Saved labels with the fresh ones over them; labels outside ``known`` are not taken."""
    new = fresh.join(known.select("label"), "label", "left_semi").select(*KEY, F.col("label").alias("fresh"))
    return saved.join(new, KEY, "full").select(*KEY, F.coalesce("fresh", "label").alias("label"))


def labelled_hits(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits with a certain label."""
    return hits.join(labels.where("label <> 'incertain'"), KEY)


def unlabelled_hits(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Hits that no person has labelled; a model's label leaves a hit open."""
    return hits.join(labels.where(F.col("annotator") == "user"), KEY, "left_anti")


def accuracy(rows: DataFrame, *answers: str) -> DataFrame:
    """``answer, n, accuracy`` of each answer column; null answers do not count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("answer"), F.col(a).alias("value")) for a in answers]))
    long = rows.select("truth", pairs.alias("p")).select("truth", "p.*")
    return long.groupBy("answer").agg(
        F.count("value").alias("n"), F.coalesce(F.avg((F.col("value") == F.col("truth")).cast("int")), F.lit(0.0)).alias("accuracy")
    )


def confusion(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Counts of all pairs of the given classes, zeros included."""
    spark = rows.sparkSession
    c = spark.createDataFrame([(x,) for x in classes], "truth string")
    # The square of a fixed, short list of classes.
    grid = c.select("truth", F.explode(F.array(*[F.lit(x) for x in classes])).alias("pred"))
    n = rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    return grid.join(n, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def held_out(rows: DataFrame, reject: str, least: int = 30) -> DataFrame:
    """Per video and in total: rows, accuracy, false hits rejected, real hits lost."""
    sizes = rows.groupBy("video").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    big = rows.join(sizes.select("video"), "video", "left_semi")
    false = F.col("truth") == reject
    no = F.col("pred") == reject
    return big.rollup("video").agg(
        F.count("*").alias("n"),
        F.avg((F.col("pred") == F.col("truth")).cast("int")).alias("accuracy"),
        F.count_if(false & no).alias("false_rejected"), F.count_if(false).alias("false_hits"),
        F.count_if(~false & no).alias("real_lost"), F.count_if(~false).alias("real_hits"),
        F.avg(F.when(~false, (F.col("pred") == F.col("truth")).cast("int"))).alias("stroke_accuracy"),
    ).select(F.coalesce("video", F.lit("(all)")).alias("video"), "n", "accuracy", "false_rejected", "false_hits", "real_lost", "real_hits", "stroke_accuracy")


def hit_precision(rows: DataFrame, not_hit: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), (F.count_if(F.col("truth") != not_hit) / F.count("*")).alias("precision"))


#: Hash ranges that a class is numbered in.
HASH_DIGITS = 3


def numbered(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Rows of each group numbered from 0 in the order of their keys' hashes, as ``name``.

    Numbers are offsets of 4096 hash ranges and places within them, so that no
    task holds a whole group.
    """
    h = F.md5(F.col("key").cast("string"))
    cut = rows.withColumns({"h": h, "range": F.substring(h, 1, HASH_DIGITS)})
    sizes = cut.groupBy(group, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(group, "range").orderBy("h", "key"))
    return cut.withColumn("place", place).join(sizes, [group, "range"]).withColumn(name, F.col("before") + F.col("place") - 1).drop("range", "place", "before")


def folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """Stratified folds by a hash order within each class: at most as many as the
    least class has rows, two at least."""
    least = rows.groupBy("truth").agg(F.count("*").alias("n")).agg(F.greatest(F.lit(2), F.least(F.lit(k), F.min("n"))).alias("k"))
    # One row.
    return numbered(rows, "truth", "turn").join(F.broadcast(least)).withColumn("fold", (F.col("turn") % F.col("k")).cast("int")).drop("turn", "k", "h")


def class_weights(rows: DataFrame) -> DataFrame:
    """Rows over rows of the class and number of classes."""
    n = rows.groupBy("truth").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    # One row of totals.
    return n.join(F.broadcast(total)).select("truth", "n", (F.col("all") / F.greatest("n", F.lit(1)) / F.col("classes")).alias("weight"))


def select_for_annotation(hits: DataFrame, n: int, already: DataFrame | None = None) -> DataFrame:
    """Up to half disagreements, least certain first, then classes in turn; in hash order.

    hits: ``video, key, stroke``, the labels ``stroke_pose, stroke_vlm, stroke_clf`` of each
    method (null or empty: none) and ``clf_prob``. A disagreement is a pose label
    that differs, as a merged class, from the model's or the classifier's.
    Hits ``already`` labelled are left out. The result is a report of ``n`` rows,
    its limit the feature.
    """
    todo = hits if already is None else hits.join(already.select(*KEY).distinct(), KEY, "left_anti")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    other = lambda c: given(c) & ~merged_class(c).eqNullSafe(merged_class("stroke_pose"))
    differs = given("stroke_pose") & (other("stroke_vlm") | other("stroke_clf"))
    sure = F.when(given("stroke_clf"), F.col("clf_prob")).otherwise(1.0)
    t = todo.withColumns({"h": F.md5(F.col("key").cast("string")), "differs": differs, "sure": sure})
    first = t.where("differs").orderBy("sure", "h", *KEY).limit(n // 2).withColumn("part", F.lit(0)).withColumn("turn", F.lit(0))
    # Spark keeps the first n of each class in every task before the shuffle.
    turn = F.row_number().over(Window.partitionBy("stroke").orderBy("h", *KEY))
    rest = t.where("not differs").withColumns({"part": F.lit(1), "turn": turn}).where(F.col("turn") <= n)
    cols = ["part", "turn", "stroke", "sure", "h", *KEY]
    both = first.select(*cols).unionByName(rest.select(*cols))
    order = [F.col("part"), F.when(F.col("part") == 0, F.col("sure")), F.col("turn"), F.when(F.col("part") == 1, F.col("stroke")), "h", *KEY]
    return both.orderBy(*order).limit(n).select("part", "stroke", *KEY)


#: Labels that are no stroke to be shown as an example.
NO_REFERENCE = ("incertain", "pas_une_frappe", "bandeja_ou_vibora")


def references(labels: DataFrame) -> DataFrame:
    """One labelled hit for each stroke; people's labels before others."""
    rank = F.when(F.col("annotator") == "user", 0).otherwise(1)
    first = labels.where(~F.col("label").isin(*NO_REFERENCE)).groupBy("label").agg(F.min(F.struct(rank.alias("rank"), *KEY, "annotator")).alias("m"))
    return first.select("label", "m.video", "m.key", "m.annotator")


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their deviation."""
    stats = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    joined = rows.join(F.broadcast(stats))
    return joined.select(*KEY, *[((F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-6)).alias(c) for c in columns])


def fit_mlp(x: np.ndarray, y: np.ndarray, classes: int, hidden: int = 64, epochs: int = 300, seed: int = 0) -> dict:
    """One hidden layer with ReLU and dropout, AdamW, class weights and input noise."""
    rng = np.random.default_rng(seed)
    mu, sd = x.mean(0), x.std(0) + 1e-6
    z = (x - mu) / sd
    sizes = [(x.shape[1], hidden), (hidden, classes)]
    p = [v for a, b in sizes for v in (rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b))]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    count = np.bincount(y, minlength=classes)
    weight = (len(y) / np.maximum(count, 1) / classes)[y]
    for step in range(1, epochs + 1):
        a = z + rng.normal(0, 0.15, z.shape)
        pre = a @ p[0] + p[1]
        keep = (pre > 0) * (rng.random(pre.shape) > 0.3) / 0.7
        hid = pre * keep
        logits = hid @ p[2] + p[3]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        d = prob * (weight / weight.sum())[:, None]
        back = (d @ p[2].T) * keep
        grads = [a.T @ back, back.sum(0), hid.T @ d, d.sum(0)]
        for q, g, mm, vv in zip(p, grads, m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            q -= 3e-3 * (mm / (1 - 0.9**step) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8) + 1e-2 * q)
    return {"p": p, "mu": mu, "sd": sd}


def predict_mlp(model: dict, x: np.ndarray) -> np.ndarray:
    p = model["p"]
    logits = np.maximum((x - model["mu"]) / model["sd"] @ p[0] + p[1], 0) @ p[2] + p[3]
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: Labelled rows that a classifier is fitted on, at most; people make them one by one.
MAX_LABELLED = 50_000


def cross_validate(samples: DataFrame, classes: list[str], k: int = 5, most: int = MAX_LABELLED) -> DataFrame:
    """Out-of-fold predictions of the classifier: one group of tasks for each fold.

    ``samples``: key, truth, features, fold. Each fold trains on all others, so
    a fold's task holds the labelled rows, at most ``most`` of them in hash order.
    """

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # The fit sums in the order of its rows.
        pdf = pdf.sort_values("key", ignore_index=True)
        test = pdf["fold"] == pdf["part"]
        if test.all() or not test.any():
            return pd.DataFrame({"key": [], "truth": [], "pred": [], "prob": []})
        x = np.stack(pdf["features"].to_numpy())
        y = pdf["truth"].map(classes.index).to_numpy()
        model = fit_mlp(x[~test], y[~test], len(classes))
        prob = predict_mlp(model, x[test])
        return pd.DataFrame({"key": pdf["key"][test], "truth": pdf["truth"][test], "pred": [classes[i] for i in prob.argmax(1)], "prob": prob.max(1)})

    bounded = samples.orderBy(F.md5(F.col("key").cast("string")), "key").limit(most)
    parts = bounded.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return parts.groupBy("part").applyInPandas(run, "key long, truth string, pred string, prob double")


def score_with_model(rows: DataFrame, model: dict, classes: list[str]) -> DataFrame:
    """Labels and probabilities of a fitted classifier, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                prob = predict_mlp(model, np.stack(pdf["features"].to_numpy()))
                yield pd.DataFrame({"key": pdf["key"], "label": [classes[i] for i in prob.argmax(1)], "prob": prob.max(1)})

    return rows.select("key", "features").mapInPandas(run, "key long, label string, prob double")


