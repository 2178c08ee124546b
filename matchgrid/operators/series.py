"""Frame-level signals: differences, cuts, gaps, smoothing, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_distance(signals: DataFrame) -> DataFrame:
    """``dist`` (half the summed histogram change) and ``motion`` (mean change) to
    the previous frame of the video; 0 for the first."""
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x))
    hist = F.transform("vec", lambda x: F.abs(x) / F.col("total"))
    w = Window.partitionBy("video_key").orderBy("frame")
    s = signals.withColumn("total", total).withColumn("hist", hist)
    s = s.withColumns({"h0": F.lag("hist").over(w), "v0": F.lag("vec").over(w)})

    def change(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)

    return s.select(
        "video_key", "frame",
        F.coalesce(change("hist", "h0") / 2, F.lit(0.0)).alias("dist"),
        F.coalesce(change("vec", "v0") / F.size("vec"), F.lit(0.0)).alias("motion"),
    )


def min_gap(sorted_values: str, gap: float, first: str = "cast(array() as array<bigint>)") -> Column:
    """Greedy choice from a sorted array: a value stays if it is ``gap`` behind the last kept.

    The array holds the cuts of one video, some hundreds.
    """
    return F.expr(
        f"aggregate({sorted_values}, {first}, (kept, c) -> "
        f"if(size(kept) = 0 or c - element_at(kept, -1) >= {gap}, concat(kept, array(c)), kept))"
    )


def jump_cuts(
    motion: DataFrame, fps: float, ratio: float = 6.0, floor: float = 1.5, isolation: float = 2.5,
    local_floor: float = 0.3, min_shot_s: float = 2.0,
) -> DataFrame:
    """``video_key, cuts``: one-frame spikes of motion far over their surroundings.

    The local level is the median of 31 frames; behind either end the series is
    mirrored, again and again where it has fewer than 15 frames.
    """
    w = Window.partitionBy("video_key").orderBy("frame")
    n = F.count("*").over(Window.partitionBy("video_key"))
    m = motion.select("video_key", "motion", (F.row_number().over(w) - 1).alias("i"), n.alias("n"))
    # Rows mirrored behind either end: -1 repeats 0, -2 repeats 1, and so on, with period 2n.
    turn = F.explode(F.expr("filter(sequence(-cast(ceil(15 / n) as int), cast(ceil(15 / n) as int)), k -> k <> 0)")).alias("turn")
    turned = m.where("i < 15 OR i >= n - 15").select("video_key", "motion", "i", "n", turn)
    # An even turn repeats the series, an odd one its mirror image.
    place = F.when(F.col("turn") % 2 == 0, F.col("turn") * F.col("n") + F.col("i")).otherwise((F.col("turn") + 1) * F.col("n") - 1 - F.col("i"))
    turned = turned.select("video_key", "motion", place.alias("i"), "n").where("i >= -15 AND i < n + 15")
    padded = m.unionByName(turned)
    by = Window.partitionBy("video_key").orderBy("i")
    at = [F.lag("motion", 2).over(by), F.lag("motion", 1).over(by), F.lead("motion", 1).over(by), F.lead("motion", 2).over(by)]
    seen = padded.withColumns({
        "base": F.percentile("motion", 0.5).over(by.rowsBetween(-15, 15)),
        "near": F.greatest(*at),
    })
    spikes = seen.where("i >= 2 AND i < n - 2").where(
        (F.col("motion") > ratio * F.greatest("base", F.lit(local_floor)))
        & (F.col("motion") > floor) & (F.col("motion") > isolation * F.col("near"))
    )
    cuts = spikes.groupBy("video_key").agg(F.array_sort(F.collect_list(F.col("i").cast("bigint"))).alias("found"))
    return cuts.select("video_key", min_gap("found", min_shot_s * fps).alias("cuts"))


def split_shots(
    dist: DataFrame, fps: float, threshold: float = 0.3, min_shot_s: float = 0.6, extra: DataFrame | None = None
) -> DataFrame:
    """``video_key, shot_id, start_f, end_f``: half-open frame ranges between cuts.

    Frames are numbered from 0 in each video. Cuts are the frames over the
    threshold, with ``extra`` (``video_key, cuts``), and keep a least distance;
    a short end joins the shot before.
    """
    gap = min_shot_s * fps
    w = Window.partitionBy("video_key").orderBy("frame")
    d = dist.select("video_key", "dist", (F.row_number().over(w) - 1).cast("bigint").alias("i"))
    found = d.groupBy("video_key").agg(
        F.count("*").alias("n"), F.collect_list(F.when(F.col("dist") > threshold, F.col("i"))).alias("cuts")
    )
    if extra is not None:
        more = extra.select("video_key", F.col("cuts").alias("more"))
        found = found.join(more, "video_key", "left").withColumn(
            "cuts", F.array_union("cuts", F.coalesce("more", F.expr("cast(array() as array<bigint>)")))
        )
    kept = found.withColumn("cuts", F.array_sort(F.array_distinct("cuts"))).select(
        "video_key", "n", min_gap("cuts", gap, "array(0L)").alias("b")
    )
    short = f"size(b) > 1 AND n - element_at(b, -1) < {gap}"
    kept = kept.withColumn("b", F.expr(f"if({short}, slice(b, 1, size(b) - 1), b)"))
    kept = kept.withColumn("b", F.concat("b", F.array("n")))
    return kept.select("video_key", F.posexplode(F.expr("slice(b, 1, size(b) - 1)")).alias("shot_id", "start_f"), "b").select(
        "video_key", "shot_id", "start_f", F.expr("element_at(b, shot_id + 2)").alias("end_f")
    )


def shot_motion(shots: DataFrame, signals: DataFrame) -> DataFrame:
    """Mean motion inside each shot, its first frame left out; 0 for one frame.

    Frames find their shot by the last shot start at or before them, as a
    window over frames and starts, without a range join.
    """
    w = Window.partitionBy("video_key").orderBy("frame")
    frames = signals.select("video_key", "motion", (F.row_number().over(w) - 1).cast("bigint").alias("i"))
    marks = shots.select("video_key", F.col("start_f").alias("i"), "shot_id")
    by = Window.partitionBy("video_key").orderBy("i")
    owned = frames.join(marks, ["video_key", "i"], "left").select(
        "video_key", "i", "motion", F.col("shot_id").alias("first"),
        F.last("shot_id", ignorenulls=True).over(by).alias("shot_id"),
    )
    mean = owned.where("first is null").groupBy("video_key", "shot_id").agg(F.avg("motion").alias("motion"))
    return shots.join(mean, ["video_key", "shot_id"], "left").withColumn("motion", F.coalesce("motion", F.lit(0.0)))


def keyframes(shots: DataFrame) -> DataFrame:
    """Frames at 20, 50 and 80 % of each shot."""
    ratios = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate((0.2, 0.5, 0.8))]))
    cut = shots.select("video_key", "shot_id", "start_f", "end_f", ratios.alias("p"))
    at = F.col("start_f") + F.floor((F.col("end_f") - F.col("start_f")) * F.col("p.r"))
    return cut.select("video_key", "shot_id", F.col("p.k").alias("k"), at.cast("bigint").alias("frame"))


def track_pieces(tracks: DataFrame, max_gap: int = 15) -> DataFrame:
    """Positions with gaps of less than ``max_gap`` frames filled on a straight line.

    ``piece`` numbers the runs of a track; longer gaps part them and are left
    out, as are the missing positions at a run's ends.
    """
    key = ["shot_id", "slot"]
    back = Window.partitionBy(*key).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # "First after" as "last before" in the other direction: a frame that only grows is computed once a row.
    ahead = Window.partitionBy(*key).orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("x").isNotNull(), F.struct("frame", "x", "y"))
    t = tracks.withColumns({"p": F.last(known, True).over(back), "q": F.last(known, True).over(ahead)})
    t = t.where("p is not null AND q is not null AND q.frame - p.frame <= " + str(max_gap))
    share = F.coalesce((F.col("frame") - F.col("p.frame")) / F.nullif(F.col("q.frame") - F.col("p.frame"), F.lit(0)), F.lit(0.0))
    t = t.withColumns({c: F.col(f"p.{c}") + (F.col(f"q.{c}") - F.col(f"p.{c}")) * share for c in ("x", "y")})
    w = Window.partitionBy(*key).orderBy("frame")
    new = F.coalesce(F.col("frame") - F.lag("frame").over(w) > 1, F.lit(True)).cast("int")
    return t.withColumn("new", new).select(*key, "frame", "x", "y", F.sum("new").over(w).cast("int").alias("piece"))


def median5(pieces: DataFrame) -> DataFrame:
    """Median of five frames, zeros beyond a piece's ends; pieces of nine frames or more."""
    key = ["shot_id", "slot", "piece"]
    w = Window.partitionBy(*key).orderBy("frame")
    n = F.count("*").over(Window.partitionBy(*key))

    def med(c: str) -> Column:
        five = [F.coalesce(F.lag(c, 2).over(w), F.lit(0.0)), F.coalesce(F.lag(c, 1).over(w), F.lit(0.0)), F.col(c)]
        five += [F.coalesce(F.lead(c, 1).over(w), F.lit(0.0)), F.coalesce(F.lead(c, 2).over(w), F.lit(0.0))]
        return F.when(n >= 9, F.element_at(F.array_sort(F.array(*five)), 3)).otherwise(F.col(c))

    return pieces.withColumns({"mx": med("x"), "my": med("y")}).select(*key, "frame", F.col("mx").alias("x"), F.col("my").alias("y"))


def pick_peaks(series: DataFrame, height: float, distance: int) -> DataFrame:
    """``key, peaks``: local maxima of ``v`` over ``i``, the higher first where too close.

    A flat top counts at its middle, the earlier of two; equal heights go by
    later place. What reaches an end of the series is no peak.
    """
    w = Window.partitionBy("key").orderBy("i")
    new = (F.col("v") != F.lag("v", 1).over(w)) | F.lag("v", 1).over(w).isNull()
    flat = series.select("key", "i", "v", new.cast("int").alias("new")).withColumn("level", F.sum("new").over(w))
    flat = flat.groupBy("key", "level").agg(F.first("v").alias("v"), F.floor((F.min("i") + F.max("i")) / 2).alias("i"))
    by = Window.partitionBy("key").orderBy("level")
    p = flat.withColumns({"a": F.lag("v").over(by), "b": F.lead("v").over(by)}).where(
        (F.col("v") > F.col("a")) & (F.col("v") > F.col("b")) & (F.col("v") >= height)
    )
    # Peaks with room between them do not compete, so each crowd of near ones is settled on its own.
    apart = (F.col("i") - F.lag("i").over(w) >= distance) | F.lag("i").over(w).isNull()
    p = p.withColumn("apart", apart.cast("int")).withColumn("crowd", F.sum("apart").over(w))
    ordered = p.groupBy("key", "crowd").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("nv"), (-F.col("i")).alias("ni"), F.col("i").cast("bigint").alias("i")))).alias("s")
    )
    kept = F.expr(
        "aggregate(s, cast(array() as array<bigint>), (k, c) -> "
        f"if(forall(k, o -> abs(o - c.i) >= {distance}), concat(k, array(c.i)), k))"
    )
    settled = ordered.select("key", kept.alias("peaks"))
    return settled.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("peaks"))).alias("peaks"))
