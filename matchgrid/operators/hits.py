"""Hits from end to end: sounds, wrist speeds and positions to typed hits and their features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.operators.decode import MIN_GAP_S, NO_HIT, alternate_hits, nearest_position, stroke_by_pose, strongest_slot
from matchgrid.operators.series import pick_peaks
from matchgrid.session import written

#: Band of a ball's impact (Hz), step of the loudness (s), least
#: distance of two onsets (s) and least strength over the median rise.
BAND, HOP_S, ONSET_GAP_S, LEAST_ONSET = (1500.0, 6000.0), 0.01, 0.25, 8.0
#: The net's place, and the keypoints by number.
NET_Y = 10.0
NOSE, SHOULDERS, ELBOWS, WRISTS, HIPS, ANKLES = 0, (5, 6), (7, 8), (9, 10), (11, 12), (15, 16)
#: Frames on either side of a hit, their step, and the version of the features.
BEFORE, STEP, FEATURE_VERSION = 15, 3, 1
#: Values of a hit: seven points at eleven moments, and seven of its context.
N_FEATURES = 7 * 2 * (2 * BEFORE // STEP + 1) + 7


def loudness(samples: np.ndarray, rate: float) -> np.ndarray:
    """Root mean square of the band of impacts in steps of ``HOP_S``.

    The band pass is that of a fourth-order Butterworth filter run in both
    directions, whose gain is known in closed form, applied to the spectrum
    of the signal continued by its point reflection at either end. The rate
    has to be over twice the band's lower end; a band over half the rate is cut.
    """
    if rate * 0.45 <= BAND[0]:
        raise ValueError(f"a rate of {rate:g} holds no sound of {BAND[0]:g} Hz and more")
    pad = min(len(samples) - 1, int(rate / 50))
    head, tail = 2 * samples[0] - samples[pad:0:-1], 2 * samples[-1] - samples[-2 : -pad - 2 : -1]
    wave = np.concatenate([head, samples, tail]).astype(np.float64)
    # Frequencies as the bilinear transform maps them.
    f = np.tan(np.pi * np.fft.rfftfreq(len(wave), 1 / rate).clip(0, rate / 2 * 0.9999) / rate)
    low, high = (np.tan(np.pi * min(b, 0.45 * rate) / rate) for b in BAND)
    with np.errstate(divide="ignore"):
        gain = 1 / (1 + ((f * f - low * high) / (f * (high - low))) ** 8)
    band = np.fft.irfft(np.fft.rfft(wave) * gain, len(wave))[pad : pad + len(samples)]
    hop = int(rate * HOP_S)
    return np.sqrt((band[: len(band) // hop * hop].reshape(-1, hop) ** 2).mean(axis=1))


def envelopes(sounds: DataFrame) -> DataFrame:
    """``shot_id, i, env`` from ``shot_id, rate, samples``: loudness of each shot in steps.

    Shots of less than half a second of sound have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("rate").to_pylist(), b.column("samples"), strict=True)
            env = [loudness(s.values.to_numpy(zero_copy_only=False), r) if s.is_valid and len(s.values) >= r / 2 else [] for r, s in rows]
            yield pa.RecordBatch.from_arrays([b.column("shot_id"), pa.array(env, pa.list_(pa.float64()))], ["shot_id", "env"])

    got = sounds.selectExpr("cast(shot_id AS long) AS shot_id", "cast(rate AS double) AS rate", "cast(samples AS array<double>) AS samples")
    return got.mapInArrow(run, "shot_id long, env array<double>").select("shot_id", F.posexplode("env").alias("i", "env"))


def onsets(strength: DataFrame) -> DataFrame:
    """``shot_id, t, v`` from the onset strengths ``key, i, v`` of each shot.

    An onset is a peak over the 95th percentile of its shot and over
    ``LEAST_ONSET``, the stronger first where two are too close.
    """
    limit = strength.groupBy("key").agg(F.percentile("v", 0.95).alias("limit"))
    # What is under the limit of its shot is no peak, but still a neighbour of one.
    level = strength.join(limit, "key").select("key", "i", F.when(F.col("v") >= F.greatest("limit", F.lit(LEAST_ONSET)), F.col("v")).otherwise(F.least("v", F.lit(0.0))).alias("v"))
    peaks = pick_peaks(level, 1e-12, int(ONSET_GAP_S / HOP_S)).select("key", F.explode("peaks").alias("i"))
    return peaks.join(strength, ["key", "i"]).select(F.col("key").alias("shot_id"), (F.col("i") * HOP_S).alias("t"), "v")


def pose_candidates(speeds: DataFrame, fps: float) -> DataFrame:
    """``shot_id, t``: peaks of the fastest wrist of all, for shots without usable sound."""
    fastest = speeds.groupBy(F.col("shot_id").alias("key"), F.col("frame").alias("i")).agg(F.max("ratio").alias("v"))
    peaks = pick_peaks(fastest, NO_HIT, int(MIN_GAP_S * fps))
    return peaks.select(F.col("key").alias("shot_id"), F.explode("peaks").alias("i")).select("shot_id", (F.col("i") / fps).alias("t"))


def candidate_times(sounds: DataFrame, speeds: DataFrame, fps: float) -> DataFrame:
    """``shot_id, cand, t, source``: onsets of each shot, or wrist peaks where there are fewer than two."""
    heard = sounds.groupBy("shot_id").agg(F.count("*").alias("n")).where("n > 1").select("shot_id")
    by_sound = sounds.join(heard, "shot_id", "left_semi").select("shot_id", "t", F.lit("audio+pose").alias("source"))
    silent = speeds.join(heard, "shot_id", "left_anti")
    both = by_sound.unionByName(pose_candidates(silent, fps).withColumn("source", F.lit("pose")))
    return both.withColumn("cand", F.xxhash64("shot_id", "t"))


def detect_hits(sounds: DataFrame, speeds: DataFrame, tracks: DataFrame, shots: DataFrame, fps: float) -> DataFrame:
    """Hits of all shots: ``shot_id, t, frame, slot, side, x, y, dist_net, speed, evidence, arm, source``.

    sounds: ``shot_id, t`` (seconds in the shot); speeds: ``shot_id, slot, frame,
    speed, ratio, arm``; tracks: ``shot_id, slot, frame, x, y``; shots: ``shot_id,
    start``. Each candidate is offered to the fastest wrist of either team around
    it; the best alternating series decides; a hit is where its slot is known
    at the nearest frame, and goes where that is nowhere.
    """
    # Slots, scores and hits read the candidates.
    cands = written(candidate_times(sounds, speeds, fps), "candidates")
    best = strongest_slot(cands, speeds.select("shot_id", "slot", "frame", F.col("ratio").alias("speed")), fps)
    score = lambda k: F.coalesce(F.max(F.when(F.col("team") == k, F.col("speed"))), F.lit(0.0))
    scored = best.groupBy("shot_id", "cand").agg(score(0).alias("s0"), score(1).alias("s1")).join(cands, ["shot_id", "cand"])
    chosen = alternate_hits(scored.withColumnRenamed("shot_id", "video_key")).where("team is not null").withColumnRenamed("video_key", "shot_id")
    found = chosen.join(best.withColumnRenamed("speed", "evidence"), ["shot_id", "cand", "team"]).join(cands, ["shot_id", "cand"])
    found = found.join(speeds.select("shot_id", "slot", "frame", "speed", "arm"), ["shot_id", "slot", "frame"])
    at = nearest_position(found.select("shot_id", "slot", "frame").distinct(), tracks)
    found = found.join(at, ["shot_id", "slot", "frame"]).join(shots.select("shot_id", "start"), "shot_id")
    return found.select(
        "shot_id", F.bround(F.col("start") + F.col("t"), 3).alias("t"), "frame", "slot", F.when(F.col("team") == 0, "far").otherwise("near").alias("side"),
        F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"), F.bround(F.abs(F.col("y") - NET_Y), 2).alias("dist_net"),
        F.bround("speed", 3).alias("speed"), F.bround("evidence", 2).alias("evidence"),
        F.when(F.col("arm") == 1, "right").otherwise("left").alias("arm"), "source",
    )


def hit_key() -> Column:
    """Stable name of a hit in its video."""
    return F.concat_ws(":", "shot_id", "frame", "slot")


def pose_measures(hits: DataFrame, poses: DataFrame) -> DataFrame:
    """Hits with ``height`` (low, high, head), ``overhead``, ``forehand`` and ``wrist_low`` from the keypoints.

    poses: ``shot_id, slot, frame, kpts`` (17 of x, y, c). The wrist's top is
    that of five frames about the hit, of those where it is sure. Hits
    without a pose at their frame are left out. Each pose is judged for either
    arm before it meets the hits, so that no keypoints travel.
    """
    fields = {"n": NOSE, "ls": SHOULDERS[0], "rs": SHOULDERS[1], "lh": HIPS[0], "rh": HIPS[1], "left": WRISTS[0], "right": WRISTS[1]}
    p = poses.select("shot_id", "slot", "frame", *[F.get("kpts", F.lit(k))[c].alias(f"{name}_{c}") for name, k in fields.items() for c in "xyc"])
    five = Window.partitionBy("shot_id", "slot").orderBy("frame").rangeBetween(-2, 2)
    p = p.withColumns({f"{arm}_top": F.min(F.when(F.col(f"{arm}_c") > 0.3, F.col(f"{arm}_y"))).over(five) for arm in ("left", "right")})
    c = F.col
    p = p.withColumns({
        "hip_x": (c("lh_x") + c("rh_x")) / 2, "hip_y": (c("lh_y") + c("rh_y")) / 2, "shoulder": F.least("ls_y", "rs_y"),
        "head": F.when(c("n_c") > 0.3, c("n_y")).otherwise(F.least("ls_y", "rs_y") - 0.25 * F.abs(c("lh_y") - c("ls_y"))),
    })
    p = p.withColumn("body", F.greatest(F.abs(c("hip_y") - c("head")), F.lit(1.0)))
    shoulder = F.when(F.least("ls_c", "rs_c") > 0.3, c("shoulder")).otherwise(c("head") + 0.2 * c("body"))

    def judged(arm: str) -> Column:
        top, x, y = F.coalesce(f"{arm}_top", f"{arm}_y"), c(f"{arm}_x"), c(f"{arm}_y")
        overhead = top < c("head") - 0.05 * c("body")
        # The impact's side of the axis from the left to the right hip.
        side = (x - c("hip_x")) * (c("rh_x") - c("lh_x")) + (y - c("hip_y")) * (c("rh_y") - c("lh_y"))
        return F.struct(
            overhead.alias("overhead"), F.when(overhead, "head").when(top < shoulder, "high").otherwise("low").alias("height"),
            ((side > 0) == F.lit(arm == "right")).alias("forehand"), (y > c("hip_y") - 0.3 * c("body")).alias("wrist_low"),
        )

    both = p.select("shot_id", "slot", "frame", judged("left").alias("left_arm"), judged("right").alias("right_arm"))
    h = hits.join(both, ["shot_id", "slot", "frame"])
    own = F.when(F.col("arm") == "right", F.col("right_arm")).otherwise(F.col("left_arm"))
    return h.withColumns({k: own[k] for k in ("overhead", "height", "forehand", "wrist_low")}).drop("left_arm", "right_arm")


def typed_hits(hits: DataFrame, poses: DataFrame, shots: DataFrame) -> DataFrame:
    """Hits with their stroke by pose; the first of each shot may be the service."""
    first = hits.withColumn("first_t", F.min("t").over(Window.partitionBy("shot_id")))
    h = pose_measures(first, poses).join(shots.select("shot_id", "start"), "shot_id")
    h = h.withColumns({"first_in_shot": F.col("t") == F.col("first_t"), "since_start": F.col("t") - F.col("start"), "dist": F.col("dist_net")})
    return stroke_by_pose(h).drop("first_t", "start", "dist", "first_in_shot", "since_start").withColumn("stroke_pose", F.col("stroke"))


#: Left and right keypoint of each pair; an arm is wrist, elbow and shoulder.
ARM = (WRISTS, ELBOWS, SHOULDERS)


def between_sure(values: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Series along the second axis, with unsure values on a line between the sure ones around.

    Before the first and behind the last sure value it is that value; a series
    without any is unknown. ``values`` is (hits, frames, points, 2), ``sure`` has no last axis.
    """
    n = sure.shape[1]
    at = np.arange(n)[None, :, None]
    low = np.maximum.accumulate(np.where(sure, at, -1), axis=1)
    high = np.minimum.accumulate(np.where(sure, at, n)[:, ::-1], axis=1)[:, ::-1]
    none = (low < 0) & (high >= n)
    low, high = np.where(low < 0, high, low), np.where(high >= n, low, high)
    low, high = np.where(none, 0, low), np.where(none, 0, high)
    part = np.where(high > low, (at - low) / np.maximum(high - low, 1), 0.0)[..., None]
    ends = [np.take_along_axis(values, k[..., None], axis=1) for k in (low, high)]
    return np.where(none[..., None], np.nan, ends[0] * (1 - part) + ends[1] * part)


def swing_features(kpts: np.ndarray, hits: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of all hits at once (hits, ``N_FEATURES``), and which hits' keypoints say enough.

    kpts: (hits, 31, 17, 3), the frames around each hit. The picture is that of a right-handed player
    seen from behind: of a left-hander the left arm counts as the right one, and one mirror, for the
    hand or for the far side, is undone by the other. Centred at the hips and scaled
    by the body's height at the hit.
    """
    n, left, far = len(kpts), hits["arm"] == "left", hits["slot"] < 2
    hand = [np.where(left, pair[0], pair[1]) for pair in ARM]
    fixed = [NOSE, *HIPS, *ANKLES, *SHOULDERS]
    chosen = np.stack([*hand, np.where(left, WRISTS[1], WRISTS[0]), *(np.full(n, k) for k in fixed)], axis=1)
    own = np.take_along_axis(kpts, chosen[:, None, :, None].astype(np.int64), axis=2)
    xy = between_sure(own[..., :2], own[..., 2] > 0.3)
    xy[..., 0] *= np.where(left ^ far, -1.0, 1.0)[:, None, None]
    middle = lambda k: xy[:, :, k : k + 2].mean(axis=2)
    hips, ankles, shoulders = middle(5), middle(7), middle(9)
    centre, foot = hips[:, BEFORE], ankles[:, BEFORE]
    head = np.where(np.isnan(xy[:, BEFORE, 4]), shoulders[:, BEFORE], xy[:, BEFORE, 4])
    span = lambda a, b: np.hypot(a[:, 0] - b[:, 0], a[:, 1] - b[:, 1])
    # Where no ankle is known the body is 2.2 times as high as its upper part.
    tall = np.where(np.isnan(foot).any(axis=1), 2.2 * span(head, centre), span(head, foot))
    usable = ((kpts[:, BEFORE, :, 2] > 0.3).sum(axis=1) >= 6) & ~np.isnan(centre).any(axis=1) & (tall >= 10)
    points = np.concatenate([xy[:, :, :5], hips[:, :, None], ankles[:, :, None]], axis=2)[:, ::STEP]
    with np.errstate(all="ignore"):  # of hits that are left out
        path = np.nan_to_num((points - centre[:, None, None]) / tall[:, None, None, None]).reshape(n, -1)
    context = [hits["dist_net"] / 10, np.where(far, 10 - hits["x"], hits["x"]) / 10, *(hits["height"] == k for k in ("low", "high", "head"))]
    context += [np.minimum(hits["speed"], 2.0), np.minimum(hits["evidence"], 20.0) / 10]
    return np.where(usable[:, None], np.concatenate([path, np.stack(context, axis=1)], axis=1), 0).astype(np.float32), usable


def hit_features(hits: DataFrame, poses: DataFrame) -> DataFrame:
    """``key, features`` of the hits whose keypoints say enough.

    Hits and poses of a shot, minutes of frames, meet once; the frames around a hit are slices of
    one array for each slot. Beyond the shot's ends they are the nearest that there is; a frame
    without a pose has no sure keypoint.
    """
    columns = ["arm", "x", "dist_net", "height", "speed", "evidence"]
    h = hits.select(hit_key().alias("key"), "shot_id", "slot", F.col("frame").cast("long").alias("frame"), *columns)
    flat = F.when(F.size("kpts") == 17, F.array(*[F.get("kpts", F.lit(k))[c].cast("double") for k in range(17) for c in "xyc"]))
    p = poses.select("shot_id", "slot", F.col("frame").cast("long").alias("frame"), flat.alias("k"))
    kind = pa.list_(pa.float32())

    def run(own: pa.Table, seen: pa.Table) -> pa.Table:
        keys, rows = [], []
        last = pc.max(seen.column("frame")).as_py()
        if own.num_rows and last is not None and last >= 0:
            seen = seen.filter(pc.and_(pc.greater_equal(seen.column("frame"), 0), pc.is_valid(seen.column("k"))))
            values = seen.column("k").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 17, 3)
            at, of = seen.column("frame").to_numpy(), seen.column("slot").to_numpy()
            cells = {c: own.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "frame", *columns)}
            name = own.column("key").to_numpy(zero_copy_only=False)
            for slot in np.unique(cells["slot"]):
                dense = np.zeros((last + 1, 17, 3))
                dense[at[of == slot]] = values[of == slot]
                mine = np.flatnonzero(cells["slot"] == slot)
                for k in range(0, len(mine), 512):
                    part = mine[k : k + 512]
                    around = np.clip(cells["frame"][part, None] + np.arange(-BEFORE, BEFORE + 1), 0, last)
                    found, usable = swing_features(dense[around], {c: v[part] for c, v in cells.items()})
                    keys += name[part[usable]].tolist()
                    rows.append(found[usable])
        flat = np.concatenate(rows) if rows else np.empty((0, N_FEATURES), np.float32)
        ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * N_FEATURES)
        return pa.table({"key": pa.array(keys, pa.string()), "features": pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), kind.value_type))})

    return h.groupBy("shot_id").cogroup(p.groupBy("shot_id")).applyInArrow(run, "key string, features array<float>")
