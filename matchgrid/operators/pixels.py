"""Pictures to numbers: frame signals, signatures, court colour, line pieces and edges through a point.

Kernels on NumPy arrays of one picture, run on Arrow batches; all that compares or
gathers rows afterwards is DataFrame work. Pictures are RGB, three bytes a pixel,
row by row. A null picture, or one whose bytes are not ``width * height`` pixels,
gives no row (of signals: no change), and never fails the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Three bits a channel; a signature's width and height.
BITS, SIGNATURE = 3, (64, 36)
#: Least saturation and value of the court, tolerance of its hue, least saturated pixels.
MODE_SATURATION, LEAST_SATURATION, LEAST_VALUE, HUE_TOLERANCE, LEAST_PIXELS = 80, 60, 40, 10, 100
#: Part of the picture in which the court's hue is looked for (top, bottom, left, right).
COURT_PART = (0.55, 0.85, 0.3, 0.7)
#: Size of the top-hat and of the court's margin in pixels, and least height of a line over its surroundings.
HAT, MARGIN, LEAST_HEIGHT = 15, 9, 35
#: Least votes of a line, least piece as a share of the width, widest gap.
LEAST_VOTES, LEAST_SHARE, WIDEST_GAP = 80, 0.08, 25
#: Half a line's thickness, in which points belong to a piece.
THICK = 3.0
#: Distance of an edge line to its anchor, and widest gap of the edge.
ANCHOR_DISTANCE, EDGE_GAP = 20, 15
#: Least change of brightness a pixel across an edge.
LEAST_EDGE = 6.0

Batches = Iterator[pa.RecordBatch]


def colour_histogram(pixels: np.ndarray) -> np.ndarray:
    """Shares of the 512 joint colours of three bits a channel."""
    q = (pixels.reshape(-1, 3) >> (8 - BITS)).astype(np.int32)
    return np.bincount((q[:, 0] << 2 * BITS) | (q[:, 1] << BITS) | q[:, 2], minlength=1 << 3 * BITS) / max(1, len(q))


def with_halo(frames: DataFrame, block: int = 256) -> DataFrame:
    """Frames dealt to tasks in blocks of consecutive ones, each with the frame before its first, marked ``halo``.

    For frames in any order; the reader of raw files gives its halo without a shuffle.
    """
    f = frames.select("video_key", "frame", "pixels", F.explode(F.array(F.lit(False), F.lit(True))).alias("halo"))
    f = f.where(~F.col("halo") | ((F.col("frame") + 1) % block == 0))
    f = f.withColumn("block", F.floor((F.col("frame") + F.col("halo").cast("int")) / block))
    return f.repartition("video_key", "block").sortWithinPartitions("video_key", "block", "frame")


def frame_signals(frames: DataFrame) -> DataFrame:
    """``video_key, frame, dist, motion``: change of the colour histogram and of brightness to the frame before.

    frames: ``video_key, frame, halo, pixels``, consecutive ones of a video beside each other in a partition, as
    ``raw_frames(halo=True)`` or ``with_halo`` give them. A frame whose predecessor
    (number less one) is not there has 0 in both.
    """

    def run(batches: Batches) -> Batches:
        held: tuple = (None, None, None, None)
        for b in batches:
            out: list[tuple] = []
            for key, frame, halo, pixels in zip(*(b.column(c).to_pylist() for c in ("video_key", "frame", "halo", "pixels")), strict=True):
                dist = motion = 0.0
                if pixels is None:
                    held = (None, None, None, None)
                else:
                    rgb = np.frombuffer(pixels, np.uint8)[: len(pixels) // 3 * 3]
                    hist, grey = colour_histogram(rgb), rgb.reshape(-1, 3).mean(axis=1)
                    if held[:2] == (key, frame - 1):
                        dist = float(np.abs(hist - held[2]).sum() / 2)
                        motion = float(np.abs(grey - held[3]).mean()) if len(grey) == len(held[3]) and len(grey) else 0.0
                    held = (key, frame, hist, grey)
                if not halo:
                    out.append((key, frame, dist, motion))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["video_key", "frame", "dist", "motion"])

    f = frames.select(F.col("video_key").cast("string").alias("video_key"), F.col("frame").cast("long").alias("frame"), "halo", "pixels")
    return f.mapInArrow(run, "video_key string, frame long, dist double, motion double")


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Brightness by the weights of standard television, rounded."""
    return ((rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def area_means(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture in another size, each pixel the mean of the area it covers, by a summed-area table.

    Sums up to places between pixels are linear in between, so cut pixels count by their part.
    """
    h, w = grey.shape
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = grey.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
        low = np.minimum(places.astype(np.int64), len(table) - 2)
        part = (places - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(sums, np.arange(height + 1) * h / height)
    both = at(rows.T, np.arange(width + 1) * w / width).T
    return np.diff(np.diff(both, axis=0), axis=1) / (h / height * w / width)


def _picture(pixels: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    if pixels is None or not width or not height or len(pixels) != width * height * 3:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def _by_picture(pictures: DataFrame, keys: list[str], extra: list[str], fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows ``keys, *fn(rgb, *extra)`` of every usable picture; the keys keep their types."""
    kinds = {c: pictures.schema[c].dataType.simpleString() for c in keys}
    own = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Batches) -> Batches:
        for b in batches:
            out, at = [], []
            columns = [b.column(c).to_pylist() for c in ("width", "height", *extra)]
            for k, (pixels, w, h, *more) in enumerate(zip(b.column("pixels").to_pylist(), *columns, strict=True)):
                rgb = _picture(pixels, w, h)
                found = [] if rgb is None else fn(rgb, *more)
                out += found
                at += [k] * len(found)
            arrow = {"double": pa.float64(), "int": pa.int32(), "array<float>": pa.list_(pa.float32())}
            cols = list(zip(*out, strict=True)) or [()] * len(own)
            made = [pa.array(list(c), arrow[p.split()[1]]) for c, p in zip(cols, schema.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in keys), *made], [*keys, *own])

    p = pictures.select(*keys, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels", *extra)
    return p.mapInArrow(run, ", ".join([*(f"{c} {k}" for c, k in kinds.items()), schema]))


def signatures(pictures: DataFrame) -> DataFrame:
    """``video_key, shot_id, k, vec``: small grey versions of key frames, for ``media.reference_signature``."""

    def small(rgb: np.ndarray) -> list[tuple]:
        return [(area_means(grey_of(rgb), *SIGNATURE).astype(np.float32).ravel(),)]

    out = _by_picture(pictures, ["video_key", "shot_id", "k"], [], small, "vec array<float>")
    return out.withColumn("vec", F.col("vec").cast("array<double>"))


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in steps of two degrees (0 to 179), saturation and value (0 to 255)."""
    x = rgb.astype(np.int32)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    v = x.max(axis=-1)
    d = v - x.min(axis=-1)
    safe = np.maximum(d, 1)
    sixth = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    h = np.where(d == 0, 0, np.floor(30 * sixth + 0.5).astype(np.int32)) % 180
    return h, np.floor(255 * d / np.maximum(v, 1) + 0.5).astype(np.int32), v


def court_hue(rgb: np.ndarray) -> int | None:
    """The most frequent hue of the saturated pixels where the court is expected; of equal ones the least."""
    n, w = rgb.shape[:2]
    top, bottom, left, right = COURT_PART
    h, s, _ = hsv(rgb[int(n * top) : int(n * bottom), int(w * left) : int(w * right)])
    found = h[s > MODE_SATURATION]
    return int(np.bincount(found, minlength=180).argmax()) if len(found) >= LEAST_PIXELS else None


def hue_mask(rgb: np.ndarray, hue: int) -> np.ndarray:
    """Pixels within the tolerance of a hue, around the circle, that are neither pale nor dark."""
    h, s, v = hsv(rgb)
    d = np.abs(h - hue)
    return (np.minimum(d, 180 - d) <= HUE_TOLERANCE) & (s > LEAST_SATURATION) & (v > LEAST_VALUE)


def extreme(x: np.ndarray, n: int, low: bool) -> np.ndarray:
    """Least (or greatest) value of the square of ``n`` by ``n`` pixels around each, by doubling windows; cut at the edges."""
    f, fill = (np.minimum, np.iinfo(x.dtype).max) if low else (np.maximum, 0)
    for _ in range(2):
        padded = np.pad(x, ((n // 2, n - 1 - n // 2), (0, 0)), constant_values=fill)
        size, out = 1, padded
        while 2 * size <= n:
            out = f(out[:-size], out[size:])
            size *= 2
        x = f(out[: len(x)], out[n - size : n - size + len(x)]).T
    return x


def white_lines(rgb: np.ndarray, court: np.ndarray) -> np.ndarray:
    """Pixels brighter than all that surrounds them within some pixels, on the court or next to it."""
    grey = grey_of(rgb)
    hat = grey - extreme(extreme(grey, HAT, True), HAT, False)
    return (hat > LEAST_HEIGHT) & (extreme(court.astype(np.uint8), MARGIN, False) > 0)


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """Ends of the straight line nearest to some points, from left to right."""
    mx, my = x.mean(), y.mean()
    cov = np.cov(np.stack([x, y]), bias=True) if len(x) > 1 else np.zeros((2, 2))
    dx, dy = np.linalg.eigh(cov)[1][:, 1]
    t = (x - mx) * dx + (y - my) * dy
    ends = sorted([(mx + k * dx, my + k * dy) for k in (t.min(), t.max())])
    return tuple(float(c) for p in ends for c in p)


def pieces_of(mask: np.ndarray, least_votes: int = LEAST_VOTES, gap: float = WIDEST_GAP) -> list[tuple[float, float, float, float]]:
    """Straight pieces of a mask: votes of its pixels for lines by angle (half degrees) and offset.

    The line with most votes, moved to the middle of its thickness, is cut at its gaps; pieces of some length are taken
    out, with all pixels of their thickness, fitted anew, and the votes of these pixels
    withdrawn, until no line has votes enough.
    """
    ys, xs = np.nonzero(mask)
    least = LEAST_SHARE * mask.shape[1]
    theta = np.arange(360) * np.pi / 360
    cos, sin = np.cos(theta), np.sin(theta)
    far = int(np.hypot(*mask.shape)) + 2
    votes = np.zeros((360, 2 * far + 1), np.int32)

    def vote(x: np.ndarray, y: np.ndarray, sign: int) -> None:
        for k in range(360):
            votes[k] += sign * np.bincount(np.rint(x * cos[k] + y * sin[k]).astype(np.int64) + far, minlength=2 * far + 1).astype(np.int32)

    vote(xs, ys, 1)
    alive, out = np.ones(len(xs), bool), []
    while votes.size:
        k, rho = np.unravel_index(int(votes.argmax()), votes.shape)
        if votes[k, rho] < least_votes:
            return out
        # The line through what lies about it, twice anew: a thick line has votes for many a tilt.
        away = np.abs(xs * cos[k] + ys * sin[k] - (rho - far))
        for _ in range(3):
            near = np.flatnonzero(alive & (away <= THICK))
            x1, y1, x2, y2 = fitted(xs[near].astype(float), ys[near].astype(float))
            size = max(1e-9, float(np.hypot(x2 - x1, y2 - y1)))
            dx, dy = (x2 - x1) / size, (y2 - y1) / size
            away = np.abs((xs - x1) * dy - (ys - y1) * dx)
        near = np.flatnonzero(alive & (away <= THICK))
        t = (xs[near] - x1) * dx + (ys[near] - y1) * dy
        order = np.argsort(t, kind="stable")
        near, t = near[order], t[order]
        gone = []
        for part in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t) > gap) + 1):
            own = near[part]
            # What is nearest to the line has to reach far enough, not what touches it.
            core = t[part][away[own] <= 1]
            if len(core) and core[-1] - core[0] >= least:
                out.append(fitted(xs[own].astype(float), ys[own].astype(float)))
                gone.append(own)
        if gone:
            gone = np.concatenate(gone)
            alive[gone] = False
            vote(xs[gone], ys[gone], -1)
        votes[k, rho] = 0  # its votes are used, whatever is left there
    return out


def line_pieces(pictures: DataFrame) -> DataFrame:
    """``video_key, hue, x1, y1, x2, y2``: white lines on the court of each picture, with the court's hue."""

    def run(rgb: np.ndarray) -> list[tuple]:
        hue = court_hue(rgb)
        return [] if hue is None else [(hue, *p) for p in pieces_of(white_lines(rgb, hue_mask(rgb, hue)))]

    return _by_picture(pictures, ["video_key"], [], run, "hue int, x1 double, y1 double, x2 double, y2 double")


def gradients(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Change of the smoothed brightness by column and by row."""
    g = grey_of(rgb).astype(np.float32)
    for _ in range(2):  # five binomial weights either way
        p = np.pad(g, ((2, 2), (0, 0)), mode="edge")
        g = ((p[:-4] + 4 * p[1:-3] + 6 * p[2:-2] + 4 * p[3:-1] + p[4:]) / 16).T
    gy, gx = np.gradient(g)
    return gx, gy


def edge_through(gx: np.ndarray, gy: np.ndarray, x: float, y: float, least_angle: float) -> tuple[float, float, float, float] | None:
    """The oblique edge on a line past a place: the ray of a fan with the greatest sum of edge strength.

    Rays pass within ``ANCHOR_DISTANCE`` of the place, at angles that are neither level nor upright;
    first a coarse fan, then a fine one about its best rays. The edge is the
    ray's strongest stretch without a wide gap, and None if that is short.
    """
    h, w = gx.shape
    s = np.arange(-int(np.hypot(h, w)), int(np.hypot(h, w)) + 1, dtype=np.float64)

    def rays(angles: np.ndarray, offsets: np.ndarray) -> list[tuple[float, float, float, tuple]]:
        out = []
        for a in angles:
            dx, dy = np.cos(np.radians(a)), np.sin(np.radians(a))
            px, py = x - offsets[:, None] * dy + s * dx, y + offsets[:, None] * dx + s * dy
            inside = (px >= 0) & (px <= w - 1) & (py >= 0) & (py <= h - 1)
            ix, iy = np.rint(np.where(inside, px, 0)).astype(np.int64), np.rint(np.where(inside, py, 0)).astype(np.int64)
            strength = np.abs(gy[iy, ix] * dx - gx[iy, ix] * dy) * inside
            strength[strength < LEAST_EDGE] = 0
            for o, e in zip(offsets, strength, strict=True):
                at = np.flatnonzero(e)
                if not len(at):
                    continue
                cuts = np.flatnonzero(np.diff(at) > EDGE_GAP) + 1
                begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])
                total = np.add.reduceat(e[at], begin)
                k = int(total.argmax())
                a0, a1 = s[at[begin[k]]], s[at[end[k] - 1]]
                if a1 - a0 >= LEAST_SHARE * w:
                    ends = sorted([(x - o * dy + t * dx, y + o * dx + t * dy) for t in (a0, a1)])
                    out.append((float(total[k]), float(a), float(o), tuple(float(c) for p in ends for c in p)))
        return sorted(out, reverse=True)

    allowed = lambda a: a[((a > least_angle) & (a < 85)) | ((a > 95) & (a < 180 - least_angle))]
    best = rays(allowed(np.arange(0, 180, 1.0)), np.arange(-ANCHOR_DISTANCE, ANCHOR_DISTANCE + 1, 2.0))[:3]
    for step, apart in ((0.25, 0.5), (0.05, 0.25)):
        found = []
        for _, a, o, _ in best:
            offsets = np.arange(o - 2 * apart, o + 2 * apart + 1e-9, apart)
            found += rays(allowed(np.arange(a - 4 * step, a + 4 * step + 1e-9, step)), offsets[np.abs(offsets) < ANCHOR_DISTANCE])
        best = sorted(found, reverse=True)[:3]
    return best[0][3] if best else None


def sidelines(pictures: DataFrame, anchors: DataFrame, least_angle: float) -> DataFrame:
    """``video_key, lx1 .. ly2, rx1 .. ry2``: the edges through two anchors of each picture; null where there is none.

    anchors: one row a video, ``video_key, lx, ly, rx, ry``.
    """

    def run(rgb: np.ndarray, lx: float, ly: float, rx: float, ry: float) -> list[tuple]:
        g = gradients(rgb)
        both = [edge_through(*g, x, y, least_angle) if x is not None and y is not None else None for x, y in ((lx, ly), (rx, ry))]
        return [tuple(c for e in both for c in (e or (None,) * 4))]

    p = pictures.join(anchors.select("video_key", *[F.col(c).cast("double").alias(c) for c in ("lx", "ly", "rx", "ry")]), "video_key")
    schema = ", ".join(f"{s}{c} double" for s in "lr" for c in ("x1", "y1", "x2", "y2"))
    return _by_picture(p, ["video_key"], ["lx", "ly", "rx", "ry"], run, schema)
