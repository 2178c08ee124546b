"""Numeric track operators that built-in functions do not express, in Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.series import median5, track_pieces


def _smoothed(c: str) -> str:
    """Least-squares parabola of an array, at each place over the ``w`` places around it.

    Near the ends it is that of the first and last ``w`` places. With places -h .. h
    the normal equations have a closed form.
    """
    at = "aggregate(sequence(0, w - 1), 0D, (s, j) -> s + {p} * {c}[m - h + j])"
    s0, s1, s2 = (at.format(p=p, c=c) for p in ("1D", "(j - h)", "(j - h) * (j - h)"))
    value = (
        f"transform(array(named_struct('m', m, 's0', {s0}, 's1', {s1}, 's2', {s2})), t ->"
        " (q4 * t.s0 - q2 * t.s2 + (w * t.s2 - q2 * t.s0) * (i - m) * (i - m)) / (w * q4 - q2 * q2) + t.s1 / q2 * (i - m))[0]"
    )
    return f"transform(sequence(0, n - 1), i -> transform(array(least(greatest(i, h), n - 1 - h)), m -> {value})[0])"


def smooth_pieces(pieces: DataFrame) -> DataFrame:
    """Least-squares smoothing of each piece of nine frames or more (after ``median5``).

    Windows of 15 frames, or the greatest odd number under the piece's length.
    One array for each piece, which belongs to one shot: minutes of frames.
    """
    key = ["shot_id", "slot", "piece"]
    rows = pieces.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("frame", "x", "y"))).alias("r"))
    rows = rows.select(*key, "r.frame", "r.x", "r.y", F.size("r").alias("n"))
    rows = rows.withColumn("w", F.least(F.lit(15), F.floor(F.col("n") / 2).cast("int") * 2 - 1)).withColumn("h", ((F.col("w") - 1) / 2).cast("int"))
    rows = rows.withColumn("q2", F.expr("h * (h + 1D) * (2 * h + 1) / 3")).withColumn("q4", F.expr("q2 * (3D * h * h + 3 * h - 1) / 5"))
    rows = rows.withColumns({f"s{c}": F.when(F.col("n") >= 9, F.expr(_smoothed(c))).otherwise(F.col(c)) for c in ("x", "y")})
    out = rows.select(*key, F.explode(F.arrays_zip("frame", F.col("sx").alias("x"), F.col("sy").alias("y"))).alias("p"))
    return out.select(*key, "p.frame", "p.x", "p.y")


def smooth_tracks(tracks: DataFrame, max_gap: int = 15) -> DataFrame:
    """Tracks as pieces with gaps filled, their median of five, smoothed."""
    return smooth_pieces(median5(track_pieces(tracks, max_gap)))


def wrist_speed(poses: DataFrame) -> DataFrame:
    """Speed of the faster wrist in body heights a frame, also over the slot's median.

    poses: ``shot_id, slot, frame, lx, ly, lc, rx, ry, rc, height``; a step
    counts only if the wrist is sure (0.3) at both ends and the body is at
    least 20 pixels high. Median of three frames, zeros beyond the ends.
    """
    key = ["shot_id", "slot"]
    w = Window.partitionBy(*key).orderBy("frame")

    def step(s: str):
        sure = (F.col(f"{s}c") >= 0.3) & (F.lag(f"{s}c").over(w) >= 0.3) & (F.col("height") >= 20)
        d = F.hypot(F.col(f"{s}x") - F.lag(f"{s}x").over(w), F.col(f"{s}y") - F.lag(f"{s}y").over(w))
        return F.coalesce(F.when(sure, d / F.col("height")), F.lit(0.0))

    p = poses.withColumns({"l": step("l"), "r": step("r"), "i": F.row_number().over(w)})
    p = p.withColumns({"arm": F.when(F.col("r") > F.col("l"), 1).otherwise(0), "v": F.greatest("l", "r")})
    # The first frame has no step and lies outside the filter.
    inner = F.when(F.col("i") > 1, F.col("v"))
    three = F.array(F.coalesce(F.lag(inner).over(w), F.lit(0.0)), F.col("v"), F.coalesce(F.lead("v").over(w), F.lit(0.0)))
    p = p.withColumn("speed", F.when(F.col("i") > 1, F.element_at(F.array_sort(three), 2)).otherwise(0.0))
    med = F.median(F.when(F.col("speed") > 0, F.col("speed"))).over(Window.partitionBy(*key))
    ratio = F.col("speed") / F.greatest(F.coalesce(med, F.lit(1.0)), F.lit(1e-3))
    return p.select(*key, "frame", "speed", ratio.alias("ratio"), "arm")


#: Metres that a position may be from the last one, and metres a second more while a slot is unseen.
REACH, SPEED = 2.5, 8.0

Last = dict[int, tuple[float, float, int]]


def follow(last: Last, frame: int, found: list[tuple[float, float, float]], fps: float, reach: float = REACH, speed: float = SPEED) -> list[tuple[int, float, float]]:
    """``slot, x, y`` of the detections ``x, y, conf`` of one frame that continue the slots' last positions, which are moved on.

    Either side of the net has two slots, and its two surest detections (of equal
    ones the leftmost) take part. Where neither slot has a position yet they are ordered by x.
    Distances are roots of summed squares, as in SQL: between equal sums the last digit decides.
    """
    taken = []
    for slots, side in (((0, 1), [p for p in found if p[1] < 10]), ((2, 3), [p for p in found if p[1] >= 10])):
        places = [p[:2] for p in sorted(side, key=lambda p: (-p[2], p[0], p[1]))[:2]]
        known = {s: last[s] for s in slots if s in last}
        apart = lambda s, p: math.sqrt((p[0] - known[s][0]) ** 2.0 + (p[1] - known[s][1]) ** 2.0) if s in known else 1.0  # noqa: B023, E731
        if known:
            orders = [list(zip(o, places, strict=False)) for o in (slots, slots[::-1])]
            pairs = min(orders, key=lambda o: sum(apart(s, p) for s, p in o))
            pairs = [(s, p) for s, p in pairs if s not in known or apart(s, p) <= reach + speed * (frame - known[s][2]) / fps]
        else:
            pairs = list(zip(slots, sorted(places), strict=False))
        for s, p in pairs:
            last[s] = (*p, frame)
            taken.append((s, *p))
    return taken


def track_players(detections: DataFrame, fps: float, reach: float = REACH, speed: float = SPEED) -> DataFrame:
    """``shot_id, frame, slot, x, y`` from detections ``shot_id, frame, x, y, conf``.

    Each side of the net has two slots. The two surest detections of a side are
    given to its slots so that the summed distance to the last positions is
    least; one that is farther than ``reach`` and ``speed`` times the unseen
    seconds is not taken. The first frame orders them by x. State runs along
    the frames of one shot, which bounds a group; ``streaming.tracking`` is the same over a stream.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last: Last = {}
        out = []
        for frame, rows in pdf.groupby("frame", sort=True):
            found = list(zip(rows["x"].tolist(), rows["y"].tolist(), rows["conf"].tolist(), strict=True))
            out += [(pdf["shot_id"].iloc[0], frame, *t) for t in follow(last, int(frame), found, fps, reach, speed)]
        return pd.DataFrame(out, columns=["shot_id", "frame", "slot", "x", "y"])

    return detections.groupBy("shot_id").applyInPandas(run, "shot_id long, frame long, slot int, x double, y double")
