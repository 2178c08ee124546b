"""Relational parts of picture and sound analysis, reports and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.scalars import CORNERS, plain_name
from matchgrid.operators.stats import PALETTE


def hit_boxes(poses: DataFrame, least_sure: float = 0.3, grow: float = 1.1) -> DataFrame:
    """Square box around the sure keypoints of a pose: centre and side; three are needed."""
    sure = F.filter("kpts", lambda k: k["c"] > least_sure)
    p = poses.withColumn("s", sure).where(F.size("s") >= 3)
    edge = lambda f, c: f(F.transform("s", lambda k: k[c]))
    x0, x1, y0, y1 = edge(F.array_min, "x"), edge(F.array_max, "x"), edge(F.array_min, "y"), edge(F.array_max, "y")
    return p.select("key", ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (F.greatest(x1 - x0, y1 - y0) * grow).alias("side"))


def feet(kpts: str, bx: Column, by: Column) -> tuple[Column, Column]:
    """Mean of the sure ankles, else the middle of the box's lower edge."""
    sure = F.filter(F.slice(kpts, 16, 2), lambda k: k["c"] > 0.4)
    mean = lambda c, other: F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, k: a + k[c]) / F.size(sure)).otherwise(other)
    return mean("x", bx), mean("y", by)


def slot_colours(patches: DataFrame) -> DataFrame:
    """Median colour of each slot in a shot."""
    return patches.groupBy("shot_id", "slot").agg(*[F.median(c).alias(c) for c in "rgb"])


def side_colours(slots: DataFrame) -> DataFrame:
    """Mean colour of the far and the near pair of slots; missing ones do not count."""
    side = F.when(F.col("slot") < 2, "far").otherwise("near")
    return slots.groupBy("shot_id", side.alias("side")).agg(*[F.avg(c).alias(c) for c in "rgb"])


def reference_signature(frames: DataFrame, shots: DataFrame, least: float = 0.6, longest: int = 8) -> DataFrame:
    """Main-camera shots by their likeness to the reference picture of their video: ``corr, kind``.

    frames: ``video_key, shot_id, k, vec`` (key frames of a shot, from 0); shots:
    ``video_key, shot_id, duration, kind``. Pictures are standardized; the
    reference is the element-wise median of the second key frames of the
    longest main shots, of two at least; likeness is the largest mean product
    of a shot's key frames, and shots under ``least`` are another angle.
    """
    n = F.size("vec")
    mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x - F.col("m")) ** 2) / n
    z = frames.withColumn("m", mean).withColumn("s", F.sqrt(var) + 1e-6)
    z = z.select("video_key", "shot_id", "k", F.transform("vec", lambda x: (x - F.col("m")) / F.col("s")).alias("z"))
    main = shots.where("kind = 'main'").select("video_key", "shot_id", "duration")
    rank = F.row_number().over(Window.partitionBy("video_key").orderBy(F.desc("duration"), "shot_id"))
    best = main.withColumn("rank", rank).where(F.col("rank") <= longest).select("video_key", "shot_id")
    # At most ``longest`` pictures of a video come together.
    seen = z.where("k = 1").join(best, ["video_key", "shot_id"]).groupBy("video_key").agg(F.collect_list("z").alias("zs")).where("size(zs) > 1")
    middle = "(x -> if(size(x) % 2 = 1, x[size(x) div 2], (x[size(x) div 2 - 1] + x[size(x) div 2]) / 2))"
    ref = seen.select("video_key", F.expr(f"transform(transform(sequence(0, size(zs[0]) - 1), p -> array_sort(transform(zs, z -> z[p]))), {middle})").alias("ref"))
    dot = F.aggregate(F.zip_with("z", "ref", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.size("z")
    own = z.join(main, ["video_key", "shot_id"]).join(ref, "video_key")
    out = own.groupBy("video_key", "shot_id").agg(F.max(dot).alias("corr"))
    return out.withColumn("kind", F.when(F.col("corr") >= least, "main").otherwise("other_angle"))


def line_width(segments: DataFrame) -> DataFrame:
    """Extent of the row bin (20 px) with the longest total of line pieces; ties to the highest bin number."""
    bins = segments.groupBy("video_key", F.bround((F.col("y1") + F.col("y2")) / 20).cast("int").alias("bin")).agg(
        F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("total"),
        (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("width"),
    )
    best = F.max(F.struct(F.bround("total", 6), "bin", "width")).alias("m")
    return bins.groupBy("video_key").agg(best).select("video_key", "m.bin", "m.width")


def onset_strength(envelope: DataFrame) -> DataFrame:
    """Rise of a loudness envelope over its median rise: ``key, i, v``; the first row has none."""
    w = Window.partitionBy("key").orderBy("i")
    rise = F.greatest(F.lit(0.0), F.coalesce(F.col("env") - F.lag("env").over(w), F.lit(0.0)))
    e = envelope.select("key", "i", rise.alias("rise"))
    return e.select("key", "i", (F.col("rise") / (F.median("rise").over(Window.partitionBy("key")) + 1e-9)).alias("v"))


def corner_boxes(places: DataFrame) -> DataFrame:
    """Boxes ``x0, y0, x1, y1`` of the corner of a picture in which a scoreboard stands, beside the columns of the rows.

    places: ``corner`` (one of ``scalars.CORNERS``), ``width, height``. The box is 45 % wide and 25 % high; of no corner it is null.
    """
    part = lambda share, c: F.floor(F.round(F.col(c) * share, 9)).cast("int")
    known = F.col("corner").isin(*CORNERS)
    x0 = F.when(known, F.when(F.col("corner").endswith("droite"), part(0.55, "width")).otherwise(0))
    y0 = F.when(known, F.when(F.col("corner").startswith("bas"), part(0.75, "height")).otherwise(0))
    return places.withColumns({"x0": x0, "y0": y0, "x1": x0 + part(0.45, "width"), "y1": y0 + part(0.25, "height")})


def player_readings(answers: DataFrame, most: int = 30) -> DataFrame:
    """Usable name and shirt readings of the first close-ups of each video.

    The limit is the feature: one reading per shot, the first ``most`` shots.
    """
    w = Window.partitionBy("video_key").orderBy("shot_id")
    first = answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    name, colour = F.trim(plain_name("name")), F.lower(F.trim("colour"))
    ok = (F.length(name) >= 3) & (name != "NULL") & colour.isin(*[p[0] for p in PALETTE])
    return first.select("video_key", "shot_id", name.alias("name"), colour.alias("colour"), ok.alias("ok")).where("ok").drop("ok")


def order_teams(votes: DataFrame) -> DataFrame:
    """Which order of two teams agrees with more votes; ``keep`` wins ties.

    votes: ``match, team`` (0 or 1) and ``near`` (cluster, 0 or 1, that the vote's colour is nearer to).
    """
    keep, swap = F.count_if(F.col("team") == F.col("near")), F.count_if(F.col("team") != F.col("near"))
    v = votes.groupBy("match").agg(keep.alias("keep"), swap.alias("swap"))
    return v.select("match", (F.col("keep") < F.col("swap")).alias("swapped"), F.greatest("keep", "swap").alias("votes"))


def before_after(rallies: DataFrame) -> DataFrame:
    """One sequence of readings: before and after each rally, in order."""
    both = F.array(F.struct(F.lit(0).alias("part"), F.col("before").alias("reading")), F.struct(F.lit(1).alias("part"), F.col("after").alias("reading")))
    return rallies.select("match", "rally", F.inline(both)).withColumn(
        "ord", (F.row_number().over(Window.partitionBy("match").orderBy("rally", "part")) - 1).cast("int")
    )


def fresh_tracks(tracks: DataFrame, fps: float) -> DataFrame:
    """Stored tracks of the wanted rate; others are stale."""
    return tracks.where(F.abs(F.col("fps") - fps) <= 0.01)


def annotation_items(hits: DataFrame) -> DataFrame:
    """One JSON item per hit for a labelling page, with its ``video`` where hits have one: keys are of one video."""
    img = F.concat(F.lit("img/"), F.replace("key", F.lit(":"), F.lit("_")), F.lit(".jpg"))
    return hits.select(*[c for c in ("video",) if c in hits.columns], "key", F.to_json(F.struct("key", img.alias("img"), "t", "side", "height", F.col("stroke").alias("guess"))).alias("item"))


def rally_lines(hits: DataFrame) -> DataFrame:
    """The strokes of each rally in order, as a line of a report."""
    one = F.struct("t", F.concat_ws(" ", "player", "stroke").alias("s"))
    return hits.groupBy("shot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), " → ").alias("line"))


def stroke_table(hits: DataFrame, strokes: list[str]) -> DataFrame:
    """Players by strokes, with zeros."""
    return hits.groupBy("player").pivot("stroke", strokes).count().na.fill(0)
