"""Command line: ``python -m matchgrid COMMAND ...``; the session's settings come from Spark's own configuration."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from matchgrid.operators import decode, media, pixels, series
from matchgrid.plans import calibration, match, registry, training
from matchgrid.session import written
from matchgrid.sources import labels, packs, stores
from matchgrid.sources.frames import raw_frames


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="matchgrid")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="list the registered queries")
    run = commands.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("name", choices=sorted(registry.queries()))
    run.add_argument("tables")
    run.add_argument("out")
    keys = commands.add_parser("keys", help="show the key of each video file")
    keys.add_argument("path")
    probe = commands.add_parser("probe", help="show the facts of probe reports")
    probe.add_argument("path")
    take = commands.add_parser("import-labels", help="take labels from label files into the store")
    take.add_argument("files")
    take.add_argument("store")
    take.add_argument("--annotator", default="user")
    fit = commands.add_parser("train", help="fit the stroke classifier from the stores and print its report")
    fit.add_argument("features")
    fit.add_argument("labels")
    fit.add_argument("model")
    signals = commands.add_parser("signals", help="write histogram change and motion of raw RGB frames, and the shots they are cut into")
    signals.add_argument("path")
    signals.add_argument("out")
    for name in ("--width", "--height"):
        signals.add_argument(name, type=int, required=True)
    signals.add_argument("--fps", type=float, required=True)
    find = commands.add_parser("calibrate", help="write the map of the court of each picture (video_key, width, height, pixels)")
    find.add_argument("pictures")
    find.add_argument("out")
    tell = commands.add_parser("describe", help="write documents of videos; answers are kept in a store and asked for once")
    for name in ("videos", "utterances", "speech", "store", "out"):
        tell.add_argument(name)
    tell.add_argument("--client", required=True, help="module:function that makes a client")
    tell.add_argument("--model", default="")
    pack = commands.add_parser("annotate", help="write a pack for annotation of each video")
    for name in ("hits", "crops", "out"):
        pack.add_argument(name)
    asked = parser.parse_args(args)
    if asked.command == "queries":
        print("\n".join(sorted(registry.queries())))
        return
    spark = SparkSession.builder.appName("matchgrid").getOrCreate()
    if asked.command == "run":
        registry.queries()[asked.name](spark, asked.tables).write.mode("overwrite").parquet(asked.out)
    elif asked.command == "keys":
        labels.video_keys(spark, asked.path).show(1000, truncate=False)
    elif asked.command == "probe":
        labels.probe(spark, asked.path).show(1000, truncate=False)
    elif asked.command == "import-labels":
        fresh = labels.read_labels(spark, asked.files).selectExpr("video", "concat_ws(':', shot_id, frame, slot) AS key", "label")
        saved = stores.load_labels(spark, asked.store)
        merged = stores.import_labels(saved, fresh, fresh.select("label"), asked.annotator)
        # The store is read before its partitions are replaced.
        stores.save_labels(written(merged, "labels"), asked.store)
    elif asked.command == "signals":
        frames = raw_frames(spark, asked.path, asked.width, asked.height, asked.fps, halo="true")
        found = written(pixels.frame_signals(frames), "signals")
        found.write.mode("overwrite").parquet(f"{asked.out}/signals")
        cuts = series.jump_cuts(found.select("video_key", "frame", "motion"), asked.fps)
        series.split_shots(found.select("video_key", "frame", "dist"), asked.fps, extra=cuts).write.mode("overwrite").parquet(f"{asked.out}/shots")
    elif asked.command == "calibrate":
        calibration.calibrate(spark.read.parquet(asked.pictures)).write.mode("overwrite").parquet(asked.out)
    elif asked.command == "describe":
        module, function = asked.client.split(":")
        client = getattr(importlib.import_module(module), function)
        tables = (spark.read.parquet(p) for p in (asked.videos, asked.utterances, asked.speech))
        for name, df in match.describe(*tables, client, {"vlm": asked.model}, store=asked.store).items():
            df.write.mode("overwrite").parquet(f"{asked.out}/{name}")
    elif asked.command == "annotate":
        items = media.annotation_items(spark.read.parquet(asked.hits))
        packs.save_packs(items, spark.read.parquet(asked.crops), asked.out, list(decode.STROKES))
    else:
        samples, missing = stores.collect_samples(stores.load_features(spark, asked.features), stores.load_labels(spark, asked.labels))
        for r in missing.orderBy("video").limit(100).collect():
            print(f"{r.n_labels} labels of {r.video} have no features")
        print(training.training_report(training.train(samples, asked.model)))


if __name__ == "__main__":
    main()
