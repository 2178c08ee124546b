"""Per-player statistics, histograms, roles, geometry of the court."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.scalars import NET_ZONE, SERVICE_LINE, own_half

FAR = "slot < 2"


def is_rally() -> Column:
    """Whether a shot (``kind, replay``) is play seen by the main camera."""
    return (F.col("kind") == "main") & ~F.coalesce(F.col("replay"), F.lit(False))


def player_stats(pieces: DataFrame, fps: float, by: tuple[str, ...] = ("slot",)) -> DataFrame:
    """Per slot, or whatever else names players: seconds, distance, mean speed and shares of the court zones.

    Steps count within a piece of a track only.
    """
    w = Window.partitionBy("shot_id", "slot", "piece").orderBy("frame")
    _, depth = own_half("x", "y", F.expr(FAR))
    p = pieces.withColumns({"depth": depth, "dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)})
    n = F.count("*")
    agg = p.groupBy(*by).agg(
        n.alias("frames"),
        F.sum(F.hypot("dx", "dy")).alias("d"),
        F.count_if(F.col("depth") < NET_ZONE).alias("net"),
        F.count_if((F.col("depth") >= NET_ZONE) & (F.col("depth") < SERVICE_LINE)).alias("mid"),
        F.count_if(F.col("depth") >= SERVICE_LINE).alias("back"),
    )
    d, sec = F.coalesce("d", F.lit(0.0)), F.col("frames") / fps
    share = lambda c: F.bround(F.col(c) / F.greatest(F.col("frames"), F.lit(1)), 3)
    return agg.select(
        *by, "frames", F.bround(sec, 1).alias("seconds"), F.bround(d, 1).alias("distance_m"),
        F.bround(d / F.greatest(sec, F.lit(1e-6)), 2).alias("speed_m_s"),
        share("net").alias("net_share"), share("mid").alias("transition_share"), share("back").alias("back_share"),
    )


def heatmap(pieces: DataFrame, bins: int = 20, size: float = 10.0, every: int = 3) -> DataFrame:
    """Counts on a square grid of every third position of a piece; the last bin is closed.

    Positions are rounded to the micrometre, so that one on a grid line is in one
    bin however its sum was rounded.
    """
    w = Window.partitionBy("shot_id", "slot", "piece").orderBy("frame")
    lateral, depth = own_half("x", "y", F.expr(FAR))
    p = pieces.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") % every == 0)
    p = p.select("slot", F.bround(lateral, 6).alias("a"), F.bround(depth, 6).alias("b")).where(f"a BETWEEN 0 AND {size} AND b BETWEEN 0 AND {size}")
    cell = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) * bins / size)).cast("int")
    return p.groupBy("slot", cell("a").alias("bin_x"), cell("b").alias("bin_y")).agg(F.count("*").alias("n"))


def presence(tracks: DataFrame) -> DataFrame:
    """Share of frames in which a slot has a position."""
    return tracks.groupBy("shot_id", "slot").agg(F.avg(F.col("x").isNotNull().cast("int")).alias("presence"))


def slot_roles(tracks: DataFrame) -> DataFrame:
    """Right or left side of each slot, by mean lateral place within its pair.

    The far pair faces the camera, so its right side is on the picture's left.
    Without a mean for both, slots keep their order.
    """
    mean = tracks.groupBy("shot_id", "slot").agg(F.avg("x").alias("m"))
    pair = Window.partitionBy("shot_id", F.floor(F.col("slot") / 2))
    known = F.count("m").over(pair) == F.count("*").over(pair)
    both = mean.withColumn("m", F.when(known, F.col("m")))
    rank = F.row_number().over(pair.orderBy(F.col("m").asc_nulls_first(), "slot"))
    first = rank == 1
    role = F.when(first == F.expr(FAR), "right").otherwise("left")
    return both.select("shot_id", "slot", role.alias("role"))


def stroke_counts(hits: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Strokes per player; the two sliced overheads count as one, unknown ones as '?'."""
    key = F.when(F.col("stroke").isin("bandeja", "vibora"), "bandeja_vibora").otherwise(F.col("stroke"))
    key = F.when(key.isin(*known), key).otherwise("?")
    return hits.groupBy("player", key.alias("stroke")).agg(F.count("*").alias("n"))


def longest(shots: DataFrame, n: int) -> DataFrame:
    """The ``n`` longest shots of each video; ties by id."""
    w = Window.partitionBy("video_key").orderBy(F.desc("duration"), "shot_id")
    return shots.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sample_times(shots: DataFrame) -> DataFrame:
    """Midpoints of 1 to 8 equal parts of each shot, one a minute."""
    k = F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.col("duration") / 60))).cast("int")
    cut = shots.withColumn("k", k).select("video_key", "shot_id", "start", "duration", "k", F.explode(F.sequence(F.lit(0), k - 1)).alias("i"))
    return cut.select("video_key", "shot_id", "i", (F.col("start") + (F.col("i") + 0.5) * F.col("duration") / F.col("k")).alias("t"))


def replay_by_overlay(shots: DataFrame, majority: float = 0.7) -> DataFrame:
    """Where most main-camera shots of a video show the score, those without are replays."""
    main = F.col("kind") == "main"
    share = F.avg(F.when(main, F.col("scoreboard").cast("int"))).over(Window.partitionBy("video_key"))
    return shots.withColumn("replay", F.col("replay") | (main & ~F.col("scoreboard") & F.coalesce(share >= majority, F.lit(False))))


def last_overlay(rallies: DataFrame, overlays: DataFrame, duration: float) -> DataFrame:
    """Reading time of each rally: 0.4 s before the end of the last overlay shot that
    starts between its end and the next rally, else of the rally itself.

    Overlay shots are given to their rally by a running window, not a range join.
    """
    w = Window.partitionBy("video_key").orderBy("start", "shot_id")
    r = rallies.withColumn("until", F.coalesce(F.lead("start").over(w), F.lit(duration)))
    a = r.select("video_key", F.col("end").alias("at"), F.lit(0).alias("kind"), "shot_id", "until", F.lit(None).cast("double").alias("o_end"))
    b = overlays.select(
        "video_key", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("shot_id"),
        F.lit(None).cast("double").alias("until"), F.col("end").alias("o_end"),
    )
    by = Window.partitionBy("video_key").orderBy("at", "kind")
    rally = F.struct("shot_id", "until")
    u = a.withColumn("shot_id", F.col("shot_id").cast("bigint")).unionByName(b)
    u = u.withColumn("own", F.last(F.when(F.col("kind") == 0, rally), True).over(by))
    found = u.where("kind = 1 AND own is not null AND at < own.until").groupBy("video_key", F.col("own.shot_id").alias("shot_id"))
    best = found.agg(F.max_by("o_end", "at").alias("o_end"))
    return rallies.join(best, ["video_key", "shot_id"], "left").select(
        "video_key", "shot_id", F.bround(F.coalesce("o_end", "end") - 0.4, 3).alias("t")
    )


#: Colour names and their RGB, in order of preference on ties.
PALETTE = (
    ("rouge", 200, 50, 45), ("orange", 230, 110, 50), ("noir", 45, 45, 50), ("blanc", 225, 225, 225),
    ("bleu", 40, 70, 190), ("vert", 50, 150, 70), ("jaune", 230, 210, 60), ("rose", 230, 120, 170),
    ("gris", 130, 130, 130), ("violet", 120, 60, 160),
)


def colour_word(r: str | Column, g: str | Column, b: str | Column) -> Column:
    """Name of the nearest colour of the palette; the first on ties."""
    c = [F.col(x) if isinstance(x, str) else x for x in (r, g, b)]
    ranked = [
        F.struct(sum((x - v) * (x - v) for x, v in zip(c, rgb, strict=True)).alias("d"), F.lit(i).alias("i"), F.lit(w).alias("w"))
        for i, (w, *rgb) in enumerate(PALETTE)
    ]
    return F.array_min(F.array(*ranked))["w"]


def two_means(colours: DataFrame, by: tuple[str, ...] = ("match",), rounds: int = 10) -> DataFrame:
    """Two clusters of ``r, g, b`` for each key: ``c0`` and ``c1``, the centres, one row a key.

    Seeds are the darkest and the brightest row, then a fixed number of Lloyd
    rounds. A round is a join with the centres and an aggregation with partial sums, so
    the rows of a key, however many, need not meet in a task.
    """
    bright = F.col("r") + F.col("g") + F.col("b")
    rgb = F.struct("r", "g", "b")
    keys = list(by)
    rows = colours.where("r is not null AND g is not null AND b is not null").select(*keys, "r", "g", "b")
    centre = rows.groupBy(*keys).agg(F.min_by(rgb, F.struct(bright, rgb)).alias("c0"), F.max_by(rgb, F.struct(bright, rgb)).alias("c1"))

    def dist(c: str) -> Column:
        return F.sqrt(sum((F.col(x) - F.col(f"{c}.{x}")) ** 2 for x in "rgb"))

    near1 = dist("c0") > dist("c1")
    mean = lambda cond: F.struct(*[F.avg(F.when(cond, F.col(x))).alias(x) for x in "rgb"])
    for _ in range(rounds):
        centre = rows.join(centre, keys).groupBy(*keys).agg(mean(~near1).alias("c0"), mean(near1).alias("c1"))
    return centre


def team_votes(teams: DataFrame, seen: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Colour votes of each team, within each key: a name part of four letters or more is a word, or
    the end, of an observed name. Observed names are cut to their suffixes, so
    this is an equi-join."""
    keys = list(by)
    part = F.explode(F.filter(F.split("team", "[ /\\-]+"), lambda p: F.length(p) >= 4)).alias("part")
    parts = teams.select(*keys, "team", part).distinct()
    name = F.col("name")
    words = F.filter(F.split(name, " "), lambda x: F.length(x) >= 4)
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - 3)), lambda i: F.substring(name, i, F.length(name)))
    named = seen.select(*keys, "obs_id", "colour", F.explode(F.array_union(words, tails)).alias("part"))
    found = parts.join(named, [*keys, "part"]).select(*keys, "team", "obs_id", "colour").distinct()
    return found.groupBy(*keys, "team", "colour").agg(F.count("*").alias("votes"))


def to_court(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """Projective map of picture to court coordinates by nine numbers."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def inverse3(h: list[float]) -> list[float]:
    """Inverse of a 3 x 3 matrix by cofactors."""
    a, b, c, d, e, f, g, i, j = h
    co = [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]
    det = a * co[0] + b * co[3] + c * co[6]
    return [x / det for x in co]
