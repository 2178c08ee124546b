"""Court geometry: line pieces of a picture to the rows and ends of the court's lines, and the map to metres."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The court in metres, and a service line's distance from the back wall.
LENGTH, WIDTH, NET, SERVICE_FROM_WALL = 20.0, 10.0, 10.0, 3.05
#: A piece is level under so many degrees, and upright over so many.
LEVEL, UPRIGHT = 4.0, 60.0


def angle(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    """Degrees of a piece to the row direction, 0 to 180."""
    return F.abs(F.degrees(F.atan2(F.col(y2) - F.col(y1), F.col(x2) - F.col(x1))))


def x_at(x1: Column, y1: Column, x2: Column, y2: Column, row: Column) -> Column:
    """Where a line crosses a row."""
    return x1 + (x2 - x1) * (row - y1) / (y2 - y1)


def row_of(depth: float | Column, near: Column, net: Column, vanishing: Column) -> Column:
    """Row of a court depth from the rows of the near service line, of the net's base and of the vanishing point.

    v(y) = (a y + b) / (c y + 1) with a / c the vanishing row, through
    (LENGTH - SERVICE_FROM_WALL, near) and (NET, net), in closed form.
    """
    y1, y2 = LENGTH - SERVICE_FROM_WALL, NET
    # With b eliminated: c (y1 (near - vanishing) - y2 (net - vanishing)) = net - near.
    c = (net - near) / (y1 * (near - vanishing) - y2 * (net - vanishing))
    b = near + c * y1 * (near - vanishing)
    y = F.lit(depth) if isinstance(depth, float) else depth
    return (vanishing * c * y + b) / (c * y + 1)


def centre_lines(pieces: DataFrame) -> DataFrame:
    """``video_key, x_top, top, x_bottom, bottom``: the longest upright piece of each video."""
    up = pieces.where(angle() > UPRIGHT)
    longest = F.max(F.struct(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"), "x1", "y1", "x2", "y2")).alias("m")
    m = up.groupBy("video_key").agg(longest)
    first = F.col("m.y1") <= F.col("m.y2")
    end = lambda a, b: F.when(first, F.col(f"m.{a}")).otherwise(F.col(f"m.{b}"))
    return m.select("video_key", end("x1", "x2").alias("x_top"), end("y1", "y2").alias("top"), end("x2", "x1").alias("x_bottom"), end("y2", "y1").alias("bottom"))


def net_base_rows(pieces: DataFrame, sides: DataFrame, share: float = 0.6, tolerance: int = 3) -> DataFrame:
    """``video_key, row``: the lowest row whose level pieces span enough of the court's width.

    sides: ``video_key, top, near`` (rows) and the sidelines ``lx1 .. ly2, rx1 .. ry2``.
    Only rows between the top and 60 above the near line count. A piece takes
    part in each whole row within the tolerance, so this is an aggregation.
    """
    level = pieces.where(angle() < LEVEL).withColumn("mid", (F.col("y1") + F.col("y2")) / 2).join(sides, "video_key")
    inside = level.where("mid > top AND mid < near - 60")
    lines = inside.select("video_key", F.bround("mid").cast("int").alias("row")).distinct()
    reach = F.explode(F.expr(f"filter(sequence(cast(floor(mid) AS int) - {tolerance}, cast(ceil(mid) AS int) + {tolerance}), r -> abs(mid - r) < {tolerance})"))
    spans = level.select("video_key", "x1", "x2", reach.alias("row")).groupBy("video_key", "row").agg(
        F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b")
    )
    found = spans.join(lines, ["video_key", "row"]).join(sides, "video_key")
    left, right = (x_at(F.col(f"{s}x1"), F.col(f"{s}y1"), F.col(f"{s}x2"), F.col(f"{s}y2"), F.col("row")) for s in "lr")
    return found.where((F.col("b") - F.col("a")) / (right - left) >= share).groupBy("video_key").agg(F.max("row").alias("row"))


def row_extents(pieces: DataFrame, rows: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """``video_key, left, right``: leftmost and rightmost point of the level pieces less than ``tolerance`` from a row.

    rows: one ``video_key, row`` a video.
    """
    flat = F.least(angle(), 180 - angle()) < LEVEL
    own = pieces.where(flat).join(rows.select("video_key", "row"), "video_key").where(F.abs((F.col("y1") + F.col("y2")) / 2 - F.col("row")) < tolerance)
    return own.groupBy("video_key").agg(F.min(F.least("x1", "x2")).alias("left"), F.max(F.greatest("x1", "x2")).alias("right"))


def line_rows(pieces: DataFrame, expected: DataFrame) -> DataFrame:
    """``video_key, row, total``: the row with the greatest length of level pieces between two rows, in bins of four rows.

    expected: one ``video_key, v, lo, hi`` a video; of bins of equal length the one nearest to ``v``
    is taken, then the upper one. The row is the median of the bin's pieces.
    """
    level = pieces.where(angle() < LEVEL).withColumn("mid", (F.col("y1") + F.col("y2")) / 2).join(expected.select("video_key", "v", "lo", "hi"), "video_key")
    bins = level.where("mid BETWEEN lo AND hi").groupBy("video_key", F.bround(F.col("mid") / 4).alias("bin")).agg(
        F.sum(F.abs(F.col("x2") - F.col("x1"))).alias("total"), F.median("mid").alias("row"), F.first("v").alias("v")
    )
    best = F.max(F.struct(F.bround("total", 6).alias("total"), (-F.abs(F.col("bin") * 4 - F.col("v"))).alias("near"), (-F.col("bin")).alias("bin"), "row")).alias("m")
    return bins.groupBy("video_key").agg(best).select("video_key", "m.row", "m.total")


def inverse(h: list[Column]) -> list[Column]:
    """The adjugate of a 3 x 3 matrix, its inverse but for a factor, which a projective map does not have."""
    a, b, c, d, e, f, g, i, j = h
    return [e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d]


def mapped(h: str | list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Place of a point under a map of nine numbers, an array column or nine columns."""
    m = nine(F.col(h)) if isinstance(h, str) else h
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nine(m: Column) -> list[Column]:
    return [F.get(m, F.lit(k)) for k in range(9)]


def square_map(corners: Column) -> Column:
    """Nine numbers of the map from the unit square to four corners, times their determinant, which is the last."""
    x, y = ([F.get(corners, F.lit(k))[c] for k in range(4)] for c in "xy")
    d = (x[1] - x[2]) * (y[3] - y[2]) - (x[3] - x[2]) * (y[1] - y[2])
    g = (x[0] - x[1] + x[2] - x[3]) * (y[3] - y[2]) - (x[3] - x[2]) * (y[0] - y[1] + y[2] - y[3])
    h = (x[1] - x[2]) * (y[0] - y[1] + y[2] - y[3]) - (x[0] - x[1] + x[2] - x[3]) * (y[1] - y[2])
    row = lambda t, v: [t["d"] * (v[1] - v[0]) + t["g"] * v[1], t["d"] * (v[3] - v[0]) + t["h"] * v[3], t["d"] * v[0]]
    return let(F.struct(d.alias("d"), g.alias("g"), h.alias("h")), lambda t: F.array(*row(t, x), *row(t, y), t["g"], t["h"], t["d"]))


def fit_maps(rows: DataFrame, corners: str = "corners") -> DataFrame:
    """Adds ``h``: the map from the picture to metres by the corners of the service lines.

    corners: ``array<struct<x, y>>`` of the far left, far right, near right and near left corner. The unit
    square goes to four places in closed form; its inverse, stretched to the
    service lines' places, is the map. Null where three of the corners lie on one line.
    """
    depth = LENGTH - 2 * SERVICE_FROM_WALL

    def court_map(i: list[Column]) -> Column:
        return F.array(*[WIDTH * v for v in i[:3]], *[depth * i[3 + k] + SERVICE_FROM_WALL * i[6 + k] for k in range(3)], *i[6:])

    whole = lambda m: F.when(F.abs(F.get(m, F.lit(8))) > 1e-300, F.transform(m, lambda v: v / F.get(m, F.lit(8))))
    fitted = lambda s: F.when(F.abs(F.get(s, F.lit(8))) >= 1e-9, let(F.array(*inverse(nine(s))), lambda i: let(court_map(nine(i)), whole)))
    return rows.withColumn("h", let(F.col(corners), lambda c: let(square_map(c), fitted)))


def image_corners(h: str = "h") -> Column:
    """The court's corners in the picture, far left, far right, near right, near left, of a map to metres."""
    places = ((0.0, 0.0), (WIDTH, 0.0), (WIDTH, LENGTH), (0.0, LENGTH))
    at = lambda m, a, b: F.struct(*[c.alias(n) for c, n in zip(mapped(nine(m), F.lit(a), F.lit(b)), "xy", strict=True)])
    return let(F.array(*inverse(nine(F.col(h)))), lambda m: F.array(*[at(m, a, b) for a, b in places]))


def vanishing_rows(sides: DataFrame) -> DataFrame:
    """``video_key, vanishing``: the row in which the two sidelines meet; none if they are parallel."""
    line = lambda s: (F.col(f"{s}y1") - F.col(f"{s}y2"), F.col(f"{s}x2") - F.col(f"{s}x1"), F.col(f"{s}x1") * F.col(f"{s}y2") - F.col(f"{s}x2") * F.col(f"{s}y1"))
    (a, b, c), (d, e, f) = line("l"), line("r")
    depth = a * e - b * d
    return sides.where(F.abs(depth) >= 1e-9).select("video_key", ((c * d - a * f) / depth).alias("vanishing"))


def best_method(found: DataFrame) -> DataFrame:
    """One calibration of each video from ``video_key, method, residual_px``.

    The one by both sidelines is taken where there is one; else that of the
    smaller residual, of equal ones the high camera's.
    """
    order = F.when(F.col("method") == "sidelines", 0).otherwise(1)
    rank = Window.partitionBy("video_key").orderBy(order, "residual_px", F.when(F.col("method") == "sidelines_low", 1).otherwise(0))
    return found.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")


def on_court(x: str | Column, y: str | Column, margin: float = 0.6) -> Column:
    """Whether a place in metres lies on the court or just outside its lines."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return x.between(-margin, WIDTH + margin) & y.between(-margin, LENGTH + margin)
