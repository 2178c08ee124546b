"""Raw frames, sound, signals of pixels and calibration against loops and drawn pictures."""

import itertools
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid.operators import court, media, pixels
from matchgrid.plans import calibration
from matchgrid.sources import frames as source

W, H = 16, 9


@pytest.fixture(scope="module")
def videos(tmp_path_factory):
    """Two files of random frames, of which some repeat; the second ends within a frame."""
    folder, rng, made = tmp_path_factory.mktemp("frames"), np.random.default_rng(3), {}
    for name, n in (("a", 61), ("b", 7)):
        x = rng.integers(0, 256, (n, H, W, 3), dtype=np.uint8)
        x[3:5] = x[2]
        made[name] = x
        (folder / f"{name}.rgb").write_bytes(x.tobytes() + (b"cut" if name == "b" else b""))
    return str(folder), made


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("rate", [None, 10, 12.5])
def test_frames_by_any_partitioning(spark, videos, parts, rate):
    folder, made = videos
    got = source.raw_frames(spark, folder, W, H, 25, rate=rate, parts=parts).collect()
    want = []
    for name, x in made.items():
        for i in itertools.count():
            shown = int(i * 25 / (rate or 25) + 0.5)
            if shown >= len(x):
                break
            want.append((name, i, i / (rate or 25), False, x[shown].tobytes()))
    assert sorted((r.video_key, r.frame, r.t, r.halo, bytes(r.pixels)) for r in got) == want


def test_frames_of_a_time_range(spark, videos):
    folder, made = videos
    got = source.raw_frames(spark, folder, W, H, 25, start=0.4, end=1.2, parts=4, gray="true").collect()
    assert sorted((r.video_key, r.frame) for r in got) == [("a", i) for i in range(10, 30)]
    grey = np.floor(made["a"][10] @ np.array([19595, 38470, 7471]) / 65536 + 0.5)
    assert np.array_equal(np.frombuffer(min(got, key=lambda r: r.frame).pixels, np.uint8), grey.astype(np.uint8).ravel())
    with pytest.raises(Exception, match="no-such"):
        source.raw_frames(spark, folder + "/no-such.rgb", W, H, 25).count()


def test_filters_reach_the_reader(spark, videos):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, LessThanOrEqual

    reader = source.PushedFramesReader({"path": videos[0], "width": W, "height": H, "fps": "25", "parts": "1"})
    asked = [GreaterThanOrEqual(("t",), 0.4), LessThan(("t",), 1.2), EqualTo(("video_key",), "a")]
    assert list(reader.pushFilters(asked)) == asked
    assert [(source.key_of(p.path), p.first, p.behind) for p in reader.partitions()] == [("a", 10, 30)]
    list(reader.pushFilters([LessThanOrEqual(("t",), 0.8)]))
    assert [(p.first, p.behind) for p in reader.partitions()] == [(10, 21)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = source.raw_frames(spark, videos[0], W, H, 25, parts=2).where("t >= 0.4 AND t < 1.2 AND video_key = 'a'")
        assert sorted(r.frame for r in df.select("frame").collect()) == list(range(10, 30))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_frames_at_times_and_their_corners(spark, videos):
    folder, made = videos
    asked = [("a", 0.0, "haut_gauche"), ("a", 0.41, "bas_droite"), ("a", 2.4, "haut_droite"), ("a", 99.0, "bas_gauche"), ("none", 0.0, "bas_gauche"), ("b", None, "x"), ("b", -1.0, None)]
    times = spark.createDataFrame(asked, "video_key string, t double, corner string")
    got = {(r.video_key, r.t): r for r in media.corner_boxes(source.frames_at(times, folder, W, H, 25).withColumns({"width": F.lit(W), "height": F.lit(H)})).collect()}
    assert {k: r.frame for k, r in got.items()} == {("a", 0.0): 0, ("a", 0.41): 11, ("a", 2.4): 60, ("a", 99.0): None, ("none", 0.0): None, ("b", None): None, ("b", -1.0): None}
    assert bytes(got["a", 0.41].pixels) == made["a"][11].tobytes() and got["a", 99.0].pixels is None
    box = lambda k: tuple(got[k][c] for c in ("x0", "y0", "x1", "y1"))
    assert (box(("a", 0.0)), box(("a", 0.41)), box(("a", 2.4))) == ((0, 0, 7, 2), (8, 6, 15, 8), (8, 0, 15, 2)) and box(("b", None)) == (None,) * 4


def test_a_frame_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file: only the frames asked for are read."""
    path, size, n = tmp_path / "long.rgb", 1920 * 1080 * 3, 400
    with open(path, "wb") as f:
        f.truncate(n * size)
        f.seek(390 * size)
        f.write(b"\x07" * size)
    assert path.stat().st_size > 2 << 30
    rows = source.raw_frames(spark, str(path), 1920, 1080, 25, start=390 / 25, end=392 / 25, parts=2).select("frame", F.substring("pixels", 1, 2).alias("p")).collect()
    assert sorted((r.frame, bytes(r.p)) for r in rows) == [(390, b"\x07\x07"), (391, b"\x00\x00")]


def loop_signals(x):
    """Frame by frame."""
    out, before = [], None
    for f in x:
        h = np.zeros(512)
        for r, g, b in f.reshape(-1, 3) // 32:
            h[int(r) * 64 + int(g) * 8 + int(b)] += 1 / (W * H)
        g = f.astype(float).mean(axis=2)
        out.append((0.0, 0.0) if before is None else (np.abs(h - before[0]).sum() / 2, np.abs(g - before[1]).mean()))
        before = (h, g)
    return out


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_signals_do_not_depend_on_partitions(spark, videos, parts):
    folder, made = videos
    want = {(k, i): v for k, x in made.items() for i, v in enumerate(loop_signals(x))}
    read = source.raw_frames(spark, folder, W, H, 25, halo="true", parts=parts)
    dealt = pixels.with_halo(source.raw_frames(spark, folder, W, H, 25, parts=parts).repartition(parts, F.rand(5)), block=1 + 2 * parts)
    for frames in (read, dealt):
        got = {(r.video_key, r.frame): (r.dist, r.motion) for r in pixels.frame_signals(frames).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_signals_find_a_cut(spark, tmp_path):
    from matchgrid.operators import series

    rng = np.random.default_rng(1)
    still = rng.integers(0, 256, (2, H, W, 3))
    x = np.clip(np.concatenate([np.repeat(still[:1], 60, 0), np.repeat(still[1:], 60, 0)]) + rng.integers(-2, 3, (120, H, W, 3)), 0, 255).astype(np.uint8)
    (tmp_path / "v.rgb").write_bytes(x.tobytes())
    signals = pixels.frame_signals(source.raw_frames(spark, str(tmp_path), W, H, 30, halo="true", parts=7))
    assert series.jump_cuts(signals, 30.0).first().cuts == [60]
    assert signals.where("dist > 0.3").select("frame").collect() == [(60,)]


def test_signals_of_missing_and_odd_frames(spark):
    rows = [("v", 0, False, bytearray(30)), ("v", 2, False, bytearray(30)), ("v", 3, False, None), ("v", 4, False, bytearray(30)), ("v", 5, False, bytearray(b"\xff" * 60)), ("w", 6, False, bytearray())]
    df = spark.createDataFrame(rows, "video_key string, frame long, halo boolean, pixels binary").coalesce(1)
    got = {(r.video_key, r.frame): (r.dist, r.motion) for r in pixels.frame_signals(df).collect()}
    assert got == {("v", 0): (0, 0), ("v", 2): (0, 0), ("v", 3): (0, 0), ("v", 4): (0, 0), ("v", 5): (1, 0), ("w", 6): (0, 0)}
    assert pixels.frame_signals(df.where("false")).collect() == []


def wav(path, x, rate, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(x.astype({1: "u1", 2: "<i2", 4: "<i4"}[width]).tobytes())


@pytest.mark.parametrize("rate", [16000, 44100, 8000])
def test_sound_by_any_partitioning(spark, tmp_path, rate):
    n = rate * 3 + 17
    t = np.arange(n) / rate
    tone = 12000 * np.sin(2 * np.pi * 440 * t)
    wav(tmp_path / "x.wav", np.stack([tone + 3000, tone - 1000], axis=1), rate)
    rows = {p: sorted(source.pcm_sound(spark, str(tmp_path), seconds=0.5, parts=p).collect(), key=lambda r: r.block) for p in (1, 16)}
    assert rows[1] == rows[16]
    got = np.concatenate([r.samples for r in rows[1]])
    assert len(got) == -(-n * 16000 // rate) and [r.t for r in rows[1][:3]] == [0.0, 0.5, 1.0]
    want = (12000 * np.sin(2 * np.pi * 440 * np.arange(len(got)) / 16000) + 1000) / 32768
    assert np.abs(got - want)[100:-100].max() < 2e-3


def test_resampling_removes_what_does_not_fit(tmp_path, spark):
    """A tone over half the new rate is gone; one below stays."""
    t = np.arange(44100) / 44100
    for f, loud in ((12000, 0.01), (3000, 0.5)):
        wav(tmp_path / f"{f}.wav", (16000 * np.sin(2 * np.pi * f * t))[:, None], 44100)
        x = np.concatenate([r.samples for r in source.pcm_sound(spark, str(tmp_path / f"{f}.wav")).collect()])[200:-200]
        assert (np.abs(x).max() < loud) if f > 8000 else abs(np.abs(x).max() - 16000 / 32768) < 0.01


def test_wave_headers(tmp_path):
    def chunks(*parts):
        body = b"".join(n + struct.pack("<I", len(d) if s is None else s) + d + b"\0" * (len(d) % 2) for n, d, s in parts)
        return body

    fmt = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)
    cases = {
        "plain": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + chunks((b"fmt ", fmt, None), (b"data", bytes(40), None)),
        "list": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + chunks((b"LIST", b"abc", None), (b"fmt ", fmt, None), (b"data", bytes(40), 0xFFFFFFFF)),
        "long": b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + chunks((b"ds64", struct.pack("<QQQI", 0, 24, 6, 0), None), (b"fmt ", fmt, None), (b"data", bytes(40), 0xFFFFFFFF)),
        "other": b"OggS" + bytes(60), "empty": b"", "adpcm": b"RIFF" + struct.pack("<I", 0) + b"WAVE" + chunks((b"fmt ", struct.pack("<HHIIHH", 2, 2, 8000, 32000, 4, 4), None), (b"data", bytes(40), None)),
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
        found = source.wave_of(str(tmp_path / name))
        want = {"plain": 10, "list": 10, "long": 6}.get(name)
        assert (found.frames if found else None) == want, name


def test_area_means_equal_block_means():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 256, (72, 192)).astype(np.uint8)
    assert np.allclose(pixels.area_means(g, 64, 36), g.reshape(36, 2, 64, 3).mean(axis=(1, 3)))
    odd = pixels.area_means(g, 50, 31)
    fine = np.repeat(np.repeat(g.astype(float), 31, 0), 50, 1)  # each new pixel is whole again
    assert np.allclose(odd, fine.reshape(31, 72, 50, 192).mean(axis=(1, 3)))


def test_signatures_tell_angles_apart(spark):
    rng = np.random.default_rng(7)
    main, other = rng.integers(0, 200, (2, 72, 128, 3))
    rows = []
    for shot in range(6):
        base = other if shot == 4 else main
        for k in range(3):
            picture = np.clip(base + rng.integers(0, 20, base.shape), 0, 255).astype(np.uint8)
            rows.append(("v", shot, k, 128, 72, picture.tobytes()))
    rows.append(("v", 9, 0, 128, 72, b"short"))
    frames = pixels.signatures(spark.createDataFrame(rows, "video_key string, shot_id int, k int, width int, height int, pixels binary"))
    shots = spark.createDataFrame([("v", s, 100.0 - s, "main") for s in range(6)], "video_key string, shot_id int, duration double, kind string")
    got = {r.shot_id: r.kind for r in media.reference_signature(frames, shots).collect()}
    assert got == {s: "other_angle" if s == 4 else "main" for s in range(6)} and frames.count() == 18


def test_hue_by_hand():
    colours = {(255, 0, 0): 0, (255, 255, 0): 30, (0, 255, 0): 60, (0, 255, 255): 90, (0, 0, 255): 120, (255, 0, 255): 150, (255, 0, 9): 179, (7, 7, 7): 0}
    h, s, v = pixels.hsv(np.array([list(colours)], np.uint8))
    assert h[0].tolist() == list(colours.values()) and s[0].tolist() == [255] * 7 + [0] and v[0].tolist() == [255] * 7 + [7]


@pytest.mark.parametrize("hue", [0, 2, 9, 60, 110, 171, 178])
def test_hue_mask_around_the_circle(hue):
    """Against a loop over all pixels, with hues about zero."""
    import colorsys

    rng = np.random.default_rng(hue)
    rgb = np.array([[[round(255 * c) for c in colorsys.hsv_to_rgb((hue + d) % 180 / 180, s, v)] for d in range(-15, 16)] for s, v in rng.uniform(0.1, 1, (12, 2))], np.uint8)
    h, s, v = pixels.hsv(rgb)
    want = [[min(abs(int(a) - hue), 180 - abs(int(a) - hue)) <= 10 and b > 60 and c > 40 for a, b, c in zip(*r, strict=True)] for r in zip(h, s, v, strict=True)]
    assert pixels.hue_mask(rgb, hue).tolist() == want and 0 < np.sum(want) < len(rgb) * 31
    picture = np.zeros((40, 40, 3), np.uint8)
    picture[:, :] = [round(255 * c) for c in colorsys.hsv_to_rgb(hue / 180, 0.9, 0.8)]
    assert abs(pixels.court_hue(picture) - hue) <= 1 and pixels.court_hue(np.full((40, 40, 3), 99, np.uint8)) is None


def test_running_extremes():
    x = np.random.default_rng(0).integers(0, 256, (23, 31)).astype(np.uint8)
    for n in (1, 3, 9, 15):
        k = n // 2
        for low, f in ((True, np.min), (False, np.max)):
            want = [[f(x[max(0, i - k) : i + k + 1, max(0, j - k) : j + k + 1]) for j in range(31)] for i in range(23)]
            assert (pixels.extreme(x, n, low) == np.array(want)).all()


def drawn_line(shape, ends, thick):
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    (x1, y1), (x2, y2) = ends
    n = np.hypot(x2 - x1, y2 - y1)
    along, off = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n, ((y - y1) * (x2 - x1) - (x - x1) * (y2 - y1)) / n
    return (np.abs(off) <= thick / 2) & (along >= 0) & (along <= n)


def test_drawn_pieces_are_found():
    """Pieces at many angles, thin and thick, within a pixel; one with a wide gap is two."""
    for angle, thick in itertools.product((0, 2, 17, 45, 73, 90, 118, 160, 179), (1, 3, 5)):
        dx, dy = np.cos(np.radians(angle)) * 110, np.sin(np.radians(angle)) * 110
        ends = sorted([(200 - dx, 150 - dy), (200 + dx, 150 + dy)])
        found = pixels.pieces_of(drawn_line((300, 400), ends, thick))
        assert len(found) == 1, (angle, thick, found)
        got = sorted([found[0][:2], found[0][2:]])
        if abs(ends[0][0] - ends[1][0]) < 1:
            got, ends = (sorted(e, key=lambda p: p[1]) for e in (got, ends))
        assert np.abs(np.array(got) - np.array(ends)).max() <= 1.3, (angle, thick, got, ends)
    mask = drawn_line((300, 400), ((20, 100), (180, 100)), 3) | drawn_line((300, 400), ((220, 100), (380, 100)), 3)
    assert sorted(round(p[0]) for p in pixels.pieces_of(mask)) == [20, 220]
    mask[:, 180:210] |= drawn_line((300, 400), ((20, 100), (380, 100)), 3)[:, 180:210]
    assert len(pixels.pieces_of(mask)) == 1 and pixels.pieces_of(np.zeros((50, 50), bool)) == []


def test_edges_through_a_place():
    picture = np.full((400, 600, 3), 40, np.uint8)
    y, x = np.mgrid[:400, :600]
    picture[(x - 150) > 0.5 * (y - 50)] = 140
    g = pixels.gradients(picture)
    x1, y1, x2, y2 = pixels.edge_through(*g, 200, 150, 25)
    at = lambda row: x1 + (x2 - x1) * (row - y1) / (y2 - y1)
    assert all(abs(at(row) - (150 + 0.5 * (row - 50))) < 1 for row in (20, 150, 380)) and abs(y2 - y1) > 350
    assert pixels.edge_through(*g, 400, 150, 25) is None  # too far from the edge
    assert pixels.edge_through(*g, 200, 150, 70) is None  # too steep a bound
    assert pixels.edge_through(*pixels.gradients(np.full((90, 90, 3), 9, np.uint8)), 40, 40, 25) is None


def solved(src, dst):
    a, b = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        b += [u, v]
    return np.append(np.linalg.solve(np.array(a, float), np.array(b, float)), 1).reshape(3, 3)


def drawn_court(corners, hide_left=False, w=1280, h=720):
    """A blue court with white lines on a dark ground; its left edge may lie far beyond the sideline."""
    m = solved(corners, [(0, 0), (10, 0), (10, 20), (0, 20)])
    y, x = np.mgrid[:h, :w].astype(float)
    d = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    u, v = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / d, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / d
    picture = np.full((h, w, 3), 30, np.uint8)
    picture[(u >= (-90 if hide_left else 0)) & (u <= 10) & (v >= 0) & (v <= 20)] = (30, 80, 190)
    near = lambda c, at, half: np.abs(c - at) < half
    lines = (near(v, 3.05, 0.04) | near(v, 16.95, 0.03)) & (u >= 0) & (u <= 10) | near(u, 5, 0.025) & (v >= 3.05) & (v <= 16.95)
    if hide_left:
        lines |= near(v, 10, 0.03) & (u >= 0) & (u <= 10)
    picture[lines] = (240, 240, 240)
    return picture


def test_fit_of_maps(spark):
    rng = np.random.default_rng(4)
    quads = [[(400 + rng.normal(0, 20), 200 + rng.normal(0, 9)), (880 + rng.normal(0, 20), 205 + rng.normal(0, 9)), (1150 + rng.normal(0, 30), 610 + rng.normal(0, 9)), (120 + rng.normal(0, 30), 600 + rng.normal(0, 9))] for _ in range(40)]
    quads.append([(0, 0), (10, 0), (20, 0), (5, 30)])  # three on one line
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in q]) for k, q in enumerate(quads)], "k int, corners array<struct<x:double,y:double>>")
    s = court.SERVICE_FROM_WALL
    rows = {r.k: r for r in court.fit_maps(df).withColumn("image", court.image_corners()).collect()}
    for k, q in enumerate(quads[:-1]):
        want = solved(q, [(0, s), (10, s), (10, 20 - s), (0, 20 - s)])
        assert np.allclose(np.array(rows[k].h).reshape(3, 3), want, rtol=1e-6, atol=1e-9)
        back = np.linalg.inv(want) @ np.array([[0, 10, 10, 0], [0, 0, 20, 20], [1] * 4])
        assert np.allclose([(p.x, p.y) for p in rows[k].image], (back[:2] / back[2]).T, atol=1e-6)
    assert rows[40].h is None


def test_a_drawn_court_gives_its_map_back(spark):
    corners = {"a": [(430, 180), (850, 180), (1180, 660), (100, 660)], "b": [(480, 150), (860, 150), (1120, 640), (60, 640)]}
    rows = [(k, 1280, 720, bytearray(drawn_court(c).tobytes())) for k, c in corners.items()]
    rows += [("hidden", 1280, 720, bytearray(drawn_court(corners["a"], hide_left=True).tobytes())), ("none", 1280, 720, bytearray(1280 * 720 * 3)), ("null", 1280, 720, None)]
    got = {r.video_key: r for r in calibration.calibrate(spark.createDataFrame(rows, "video_key string, width int, height int, pixels binary").repartition(3)).collect()}
    assert got.keys() == {"a", "b", "hidden"}
    for k in ("a", "b"):
        assert got[k].method == "sidelines" and got[k].residual_px < 1.5
        m = np.array(got[k].h).reshape(3, 3)
        truth = solved(corners[k], [(0, 0), (10, 0), (10, 20), (0, 20)])
        for place in itertools.product((0, 5, 10), (3.05, 10, 16.95)):
            p, q = (np.linalg.inv(x) @ np.array([*place, 1]) for x in (m, truth))
            assert np.abs(p[:2] / p[2] - q[:2] / q[2]).max() < 1.5, (k, place)
    assert got["hidden"].method == "net" and got["hidden"].residual_px < 12
