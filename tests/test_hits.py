"""Hits from end to end: hand-made tracks, sounds and poses, and features against plain numpy."""

import numpy as np
from pyspark.sql import functions as F

from matchgrid.operators import hits as H


def test_onsets_of_clicks(spark):
    rate, n = 22050, 22050 * 3
    rng = np.random.default_rng(0)
    wave = rng.normal(0, 1e-3, n) + 0.5 * np.sin(2 * np.pi * 200 * np.arange(n) / rate)  # a low hum is outside the band
    for t in (0.5, 1.2, 2.4):
        k = int(t * rate)
        wave[k : k + 400] += np.sin(2 * np.pi * 3000 * np.arange(400) / rate) * np.exp(-np.arange(400) / 80)
    df = spark.createDataFrame([(7, float(rate), wave.tolist()), (8, float(rate), wave[:5000].tolist()), (9, float(rate), None)], "shot_id long, rate double, samples array<double>")
    env = H.envelopes(df)
    assert {r.shot_id for r in env.select("shot_id").distinct().collect()} == {7}
    from matchgrid.operators.media import onset_strength

    got = H.onsets(onset_strength(env.withColumnRenamed("shot_id", "key"))).collect()
    assert np.allclose(sorted(r.t for r in sorted(got, key=lambda r: -r.v)[:3]), (0.5, 1.2, 2.4), atol=0.03)
    at = sorted(r.t for r in got)
    assert min(np.diff(at)) >= H.ONSET_GAP_S - 1e-9 and all(r.v >= H.LEAST_ONSET for r in got)


def test_band_pass_keeps_its_band():
    rate, t = 22050, np.arange(22050) / 22050
    inside, low, high = (H.loudness(np.sin(2 * np.pi * f * t), rate)[20:80].mean() for f in (3000, 300, 10500))
    assert abs(inside - 2**-0.5) < 0.01 and low < 1e-3 and high < 1e-3


def test_detected_hits_alternate(spark):
    speeds, tracks = [], []
    for f in range(120):
        for s in range(4):
            fast = {(30, 0): 9.0, (60, 2): 8.0, (61, 3): 12.0, (90, 1): 7.0}.get((f, s), 1.0)
            speeds.append((1, s, f, fast / 10, fast, s % 2))
            tracks.append((1, s, f, None if f == 61 else float(s), None if f == 61 else 5.0 if s < 2 else 15.0))
    sp = spark.createDataFrame(speeds, "shot_id long, slot int, frame long, speed double, ratio double, arm int")
    tr = spark.createDataFrame(tracks, "shot_id long, slot int, frame long, x double, y double")
    shots = spark.createDataFrame([(1, 100.0)], "shot_id long, start double")
    sounds = spark.createDataFrame([(1, t) for t in (0.5, 1.0, 2.0, 3.0, 3.6)], "shot_id long, t double")
    got = H.detect_hits(sounds, sp, tr, shots, 30.0).orderBy("t").collect()
    assert [(r.frame, r.slot, r.side, r.arm, r.source) for r in got] == [
        (30, 0, "far", "left", "audio+pose"), (61, 3, "near", "right", "audio+pose"), (90, 1, "far", "right", "audio+pose")
    ]
    assert (got[1].t, got[1].x, got[1].dist_net, got[1].evidence) == (102.0, 3.0, 5.0, 12.0)  # position of a frame beside it
    # Without sound the wrists' own peaks are the candidates.
    mute = H.detect_hits(sounds.limit(1), sp, tr, shots, 30.0)
    assert [(r.frame, r.slot) for r in mute.orderBy("t").collect()] == [(30, 0), (61, 3), (90, 1)]
    assert {r.source for r in mute.collect()} == {"pose"}


def swing(mirror: bool) -> np.ndarray:
    """31 frames of a player of 200 pixels whose right wrist swings upwards."""
    k = np.zeros((31, 17, 3))
    k[..., 2] = 0.9
    body = {0: (0, 0), 5: (-20, 50), 6: (20, 50), 7: (-30, 80), 8: (30, 80), 9: (-35, 110), 10: (40, 110), 11: (-15, 110), 12: (15, 110), 15: (-15, 200), 16: (15, 200)}
    for p, xy in body.items():
        k[:, p, :2] = xy
    k[:, 10, 1] = 150 - 6 * np.arange(31)
    if mirror:
        k[..., 0] *= -1
        for a in range(1, 17, 2):
            k[:, [a, a + 1]] = k[:, [a + 1, a]]
    k[..., 0] += 500
    return k


def features(kpts, hit):
    """Values of one hit, or None."""
    values, usable = H.swing_features(kpts[None], {k: np.array([v]) for k, v in hit.items()})
    return values[0] if usable[0] else None


def plain_features(kpts, hit):
    """From the definition, point by point."""
    sure = kpts[..., 2] > 0.3
    if sure[15].sum() < 6:
        return None
    place = np.full((31, 17, 2), np.nan)
    for p in range(17):
        if sure[:, p].any():
            for c in range(2):
                place[:, p, c] = np.interp(range(31), np.flatnonzero(sure[:, p]), kpts[sure[:, p], p, c])
    turn = (hit["slot"] < 2) != (hit["arm"] == "left")
    if turn:
        place[..., 0] = -place[..., 0]
    arm = (9, 7, 5, 10) if hit["arm"] == "left" else (10, 8, 6, 9)
    mid = lambda a, b: (place[:, a] + place[:, b]) / 2
    hips, feet, head = mid(11, 12), mid(15, 16), place[15, 0]
    if np.isnan(head).any():
        head = mid(5, 6)[15]
    tall = np.linalg.norm(head - feet[15]) if not np.isnan(feet[15]).any() else 2.2 * np.linalg.norm(head - hips[15])
    if np.isnan(hips[15]).any() or not tall >= 10:
        return None
    out = []
    for t in range(0, 31, 3):
        for p in (*(place[t, k] for k in arm), place[t, 0], hips[t], feet[t]):
            out += [0.0 if np.isnan(v) else v for v in (p - hips[15]) / tall]
    out += [hit["dist_net"] / 10, (10 - hit["x"] if hit["slot"] < 2 else hit["x"]) / 10, hit["height"] == "low", hit["height"] == "high", hit["height"] == "head"]
    return np.array([*out, min(hit["speed"], 2), min(hit["evidence"], 20) / 10], np.float32)


def test_features_of_many_hits_at_once():
    """Against the definition, with gaps, points that are never sure and hits that say too little."""
    rng, n = np.random.default_rng(8), 300
    kpts = np.concatenate([rng.uniform(0, 300, (n, 31, 17, 2)), rng.uniform(0, 1, (n, 31, 17, 1))], axis=3)
    kpts[..., 2] *= rng.choice([0.0, 0.4, 1.0], (n, 1, 17), p=[0.15, 0.25, 0.6])
    kpts[:20, 15, :, 2] = 0.1
    hits = {"slot": rng.integers(0, 4, n), "arm": rng.choice(["left", "right"], n), "x": rng.uniform(0, 10, n), "dist_net": rng.uniform(0, 10, n),
            "height": rng.choice(["low", "high", "head"], n), "speed": rng.uniform(0, 4, n), "evidence": rng.uniform(0, 40, n)}
    values, usable = H.swing_features(kpts, hits)
    want = [plain_features(k, {c: v[i] for c, v in hits.items()}) for i, k in enumerate(kpts)]
    assert [w is not None for w in want] == usable.tolist() and 50 < usable.sum() < n
    assert all(np.allclose(v, w, atol=1e-5) for v, w in zip(values, want, strict=True) if w is not None)


HIT = {"slot": 2, "arm": "right", "x": 3.0, "dist_net": 5.0, "height": "high", "speed": 0.5, "evidence": 30.0}


def test_features_do_not_depend_on_the_view(spark):
    right = features(swing(False), HIT)
    assert len(right) == H.N_FEATURES == 161
    assert np.allclose(right, features(swing(True), HIT | {"arm": "left"}), atol=1e-6)
    # From the other side of the net the picture is mirrored, not the player.
    far = swing(False)
    far[..., 0] = 1000 - far[..., 0]
    assert np.allclose(right[:154], features(far, HIT | {"slot": 1})[:154], atol=1e-6)
    gaps = swing(False)
    gaps[3:9, 10, 2] = 0.1  # an unsure wrist lies on a line between its sure places
    gaps[3:9, 10, :2] = 0
    assert np.allclose(right, features(gaps, HIT), atol=1e-6)
    assert features(np.zeros((31, 17, 3)), HIT) is None
    # The query's way: frames beyond the shot's ends are the nearest there is.
    k = swing(False)
    rows = [(1, 2, f, [tuple(map(float, p)) for p in k[f]]) for f in range(31)]
    poses = spark.createDataFrame(rows, "shot_id long, slot int, frame long, kpts array<struct<x: double, y: double, c: double>>")
    hits = spark.createDataFrame([(1, 2, f, "right", 3.0, 5.0, "high", 0.5, 30.0) for f in (15, 2)], "shot_id long, slot int, frame long, arm string, x double, dist_net double, height string, speed double, evidence double")
    got = {r.key: r.features for r in H.hit_features(hits, poses).collect()}
    assert np.allclose(got["1:15:2"], right, atol=1e-6)
    assert np.allclose(got["1:2:2"], features(k[np.clip(np.arange(-13, 18), 0, 30)], HIT), atol=1e-6)


def test_pose_measures(spark):
    k = swing(False)
    rows = [(1, 2, f, [tuple(map(float, p)) for p in k[f]]) for f in range(31)]
    poses = spark.createDataFrame(rows, "shot_id long, slot int, frame long, kpts array<struct<x: double, y: double, c: double>>")
    hits = spark.createDataFrame([(1, f / 30, f, 2, "right", 8.0, 0.3) for f in (0, 15, 28)], "shot_id long, t double, frame long, slot int, arm string, dist_net double, speed double")
    shots = spark.createDataFrame([(1, 0.0)], "shot_id long, start double")
    got = {r.frame: r for r in H.typed_hits(hits, poses, shots).collect()}
    assert (got[0].height, got[0].wrist_low, got[0].stroke) == ("low", True, "service")
    assert (got[15].height, got[15].forehand, got[15].stroke) == ("high", True, "coup_droit")
    assert (got[28].height, got[28].overhead, got[28].stroke) == ("head", True, "bandeja")
    assert H.typed_hits(hits.where(F.col("frame") > 40), poses, shots).isEmpty()


def test_stored_hits_take_the_rules_of_today(spark):
    from matchgrid.plans.match import current_hits

    k = swing(False)
    rows = [(1, 2, f, [tuple(map(float, p)) for p in k[f]]) for f in range(31)]
    poses = spark.createDataFrame(rows, "shot_id long, slot int, frame long, kpts array<struct<x: double, y: double, c: double>>")
    # At frame 15 the wrist is high: a ground stroke of a model stays, a service does not; without a model the rule counts.
    stored = [(1, t, 15, 2, "right", 8.0, 0.3, "low", stroke, 0.9, model) for t, stroke, model in ((0.1, "revers", "revers"), (0.2, "service", "service"), (0.3, "revers", None))]
    hits = spark.createDataFrame(stored, "shot_id long, t double, frame long, slot int, arm string, dist_net double, speed double, height string, stroke string, confidence double, stroke_model string")
    got = current_hits(hits, poses, spark.createDataFrame([(1, 0.0)], "shot_id long, start double")).orderBy("t").collect()
    assert [(r.height, r.stroke, r.confidence, r.stroke_pose) for r in got] == [("high", "revers", 0.9, "coup_droit"), ("high", "coup_droit", 0.6, "coup_droit"), ("high", "coup_droit", 0.6, "coup_droit")]
