"""Calibration of cameras: from one picture of each camera to the map of its court.

Kernels give line pieces and edges of each picture; what follows, from pieces to rows,
corners, maps and residuals, is joins and aggregations by video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.operators import court, media, pixels
from matchgrid.session import written

#: Least angle of a sideline from a high and from a low camera, and rows kept free between the lines and the net.
HIGH_ANGLE, LOW_ANGLE, BELOW_FAR, ABOVE_NEAR = 25.0, 12.0, 25, 60


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _crossings(far: Column, near: Column) -> Column:
    """The four corners at which the sidelines cross two rows."""
    at = lambda s, row: _point(court.x_at(*[F.col(f"{s}{c}") for c in ("x1", "y1", "x2", "y2")], row), row)
    return F.array(at("l", far), at("r", far), at("r", near), at("l", near))


def _residual(found: DataFrame) -> DataFrame:
    """``residual_px``: how far both ends of the centre line lie from the court's middle, in pixels of the far line."""
    x = lambda m, e: court.mapped(court.nine(m), F.col(f"{e}.x"), F.col(f"{e}.y"))[0]
    off = court.let(F.col("h"), lambda m: F.greatest(*[F.abs(x(m, e) - court.WIDTH / 2) for e in ("upper", "lower")]))
    # Written, as each method is compared with the others.
    out = written(court.fit_maps(found).where("h IS NOT NULL"), "court-maps").withColumn("residual_px", off * F.col("far_width") / court.WIDTH)
    return out.select("video_key", "method", "h", "residual_px", court.image_corners().alias("image_corners"))


def ends_on_lines(centre: DataFrame, pieces: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Centre lines whose ends are moved along to the middle of the longest level piece that crosses there, if any does."""
    level = pieces.where(court.angle() < court.LEVEL).selectExpr("video_key", "(y1 + y2) / 2 AS mid", "abs(x2 - x1) AS length")
    at = level.join(centre, "video_key")
    longest = lambda end: F.max(F.when(F.abs(F.col("mid") - F.col(end)) < tolerance, F.struct("length", (-F.col("mid")).alias("m"))))
    rows = at.groupBy("video_key").agg(longest("top").alias("t"), longest("bottom").alias("b"))
    out = centre.join(rows, "video_key", "left").withColumns({"t": F.coalesce(-F.col("t.m"), "top"), "b": F.coalesce(-F.col("b.m"), "bottom")})
    x = lambda row: court.x_at(F.col("x_top"), F.col("top"), F.col("x_bottom"), F.col("bottom"), F.col(row))
    return out.select("video_key", x("t").alias("x_top"), F.col("t").alias("top"), x("b").alias("x_bottom"), F.col("b").alias("bottom"))


def high_camera(pictures: DataFrame, pieces: DataFrame) -> DataFrame:
    """Maps by the centre line, which spans both service lines, and the sidelines, or the net where one is hidden."""
    centre = ends_on_lines(court.centre_lines(pieces), pieces)
    lines = centre.join(court.row_extents(pieces, centre.select("video_key", F.col("top").alias("row"))), "video_key")
    anchors = lines.selectExpr("video_key", "`left` AS lx", "top AS ly", "`right` AS rx", "top AS ry")
    between = pieces.where(court.angle() < court.LEVEL).join(centre.select("video_key", "top", "bottom"), "video_key")
    between = between.where(f"(y1 + y2) / 2 > top + {BELOW_FAR} AND (y1 + y2) / 2 < bottom - {ABOVE_NEAR}")
    nets = media.line_width(between).select("video_key", F.col("width").alias("net"))
    f = lines.join(pixels.sidelines(pictures, anchors, HIGH_ANGLE), "video_key", "left").join(nets, "video_key", "left")
    both = F.col("lx1").isNotNull() & F.col("rx1").isNotNull()
    width, s = F.col("right") - F.col("left"), court.SERVICE_FROM_WALL
    # One over the width is affine in the court's depth; the far line and the net give it.
    slope = (1 / F.col("net") - 1 / width) / (court.NET - s)
    near = 1 / (1 / width + slope * (court.LENGTH - 2 * s))
    net = F.array(
        _point(F.col("left"), F.col("top")), _point(F.col("right"), F.col("top")),
        _point(F.col("x_bottom") + near / 2, F.col("bottom")), _point(F.col("x_bottom") - near / 2, F.col("bottom")),
    )
    f = f.where(both | F.col("net").isNotNull()).select(
        "video_key", F.when(both, "sidelines").otherwise("net").alias("method"),
        F.when(both, _crossings(F.col("top"), F.col("bottom"))).otherwise(net).alias("corners"), width.alias("far_width"),
        _point(F.col("x_top"), F.col("top")).alias("upper"), _point(F.col("x_bottom"), F.col("bottom")).alias("lower"),
    )
    return _residual(f)


def low_camera(pictures: DataFrame, pieces: DataFrame) -> DataFrame:
    """Maps by the near service line, the net's base and the sidelines' vanishing point, which fix the depth of all rows."""
    centre = court.centre_lines(pieces)
    expected = centre.selectExpr("video_key", "bottom AS v", "bottom - 0.1 * (bottom - top) AS lo", "bottom + 12 AS hi")
    rows = centre.join(court.line_rows(pieces, expected).select("video_key", "row"), "video_key", "left").withColumn("near", F.coalesce("row", "bottom"))
    lines = rows.join(court.row_extents(pieces, rows.select("video_key", F.col("near").alias("row"))), "video_key")
    anchors = lines.selectExpr("video_key", "`left` AS lx", "near AS ly", "`right` AS rx", "near AS ry")
    sides = pixels.sidelines(pictures, anchors, LOW_ANGLE).where("lx1 IS NOT NULL AND rx1 IS NOT NULL")
    sides = written(sides.join(lines.select("video_key", "x_top", "top", "x_bottom", "bottom", "near"), "video_key"), "low-sides")
    base = court.net_base_rows(pieces, sides).select("video_key", F.col("row").cast("double").alias("net"))
    f = sides.join(base, "video_key").join(court.vanishing_rows(sides), "video_key").where("vanishing < net AND net < near")
    f = f.withColumn("far", court.row_of(court.SERVICE_FROM_WALL, F.col("near"), F.col("net"), F.col("vanishing"))).where("vanishing < far AND far < net")
    middle = lambda row: _point(F.col("x_top") + (F.col("x_bottom") - F.col("x_top")) * (row - F.col("top")) / (F.col("bottom") - F.col("top")), row)
    f = f.withColumn("corners", _crossings(F.col("far"), F.col("near")))
    f = f.withColumns({"far_width": F.col("corners")[1]["x"] - F.col("corners")[0]["x"], "upper": middle(F.col("net")), "lower": middle(F.col("near")), "method": F.lit("sidelines_low")})
    return _residual(f.select("video_key", "method", "corners", "far_width", "upper", "lower"))


def calibrate(pictures: DataFrame) -> DataFrame:
    """``video_key, method, h, residual_px, image_corners, hue, width, height`` of every picture whose court is found.

    pictures: one a video, ``video_key, width, height, pixels``. ``h`` maps pixels to metres. A map by
    both sidelines of a high camera is kept; else the one of the smaller
    residual. A picture without court colour or lines has no row.
    """
    pieces = written(pixels.line_pieces(pictures), "line-pieces")
    high = written(high_camera(pictures, pieces), "high-camera")
    open_ = pictures.join(high.where("method = 'sidelines'").select("video_key"), "video_key", "left_anti")
    found = high.unionByName(low_camera(open_, pieces.join(open_.select("video_key"), "video_key", "left_semi")))
    hues = pieces.groupBy("video_key").agg(F.min("hue").alias("hue"))
    best = court.best_method(found).join(hues, "video_key")
    return best.join(pictures.select("video_key", "width", "height"), "video_key")
