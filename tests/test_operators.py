"""Hand-made expectations for the match and timeline operators."""

import json

import numpy as np
from pyspark.sql import functions as F

from matchgrid.functions import scalars as S
from matchgrid.operators import decode, learning, motion, score, series, stats, timeline
from matchgrid.sources import labels as sources
from matchgrid.streaming import tumbling


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_segments(spark):
    lengths = [0.0, 0.4, 7.0, 14.0, 30.7, 31.5]
    v = spark.createDataFrame(list(enumerate(lengths)), "video_key long, duration double")
    want = [(k, 3.5 * i, min(3.5 * i + 3.5, d)) for k, d in enumerate(lengths) for i in range(-int(-d // 3.5))]
    assert rows(timeline.plan_segments(v, 3.5), "video_key", "start", "end") == want
    assert timeline.plan_segments(v, 0.0).isEmpty()


def test_frames_to_segments(spark):
    v = spark.createDataFrame([(1, 8.6)], "video_key long, duration double")
    segs = timeline.plan_segments(v, 2.0)
    got = timeline.assign_frames(timeline.frame_grid(v, 3.0), segs, 2.0)
    assert rows(got, "frame", "t", "seg_id") == [(k, round(k / 3, 3), min(int(k / 3 / 2), 4)) for k in range(26)]
    late = spark.createDataFrame([(1, 0, 1e6)], "video_key long, frame int, t double")
    assert timeline.assign_frames(late, segs, 2.0).first().seg_id == 4


def test_heard_and_context(spark):
    rng = np.random.default_rng(4)
    said = [(1, i, float(b), float(b + d), f"w{i}") for i, (b, d) in enumerate(zip(rng.uniform(-3, 22, 30), rng.uniform(0.1, 9, 30), strict=True))]
    v = spark.createDataFrame([(1, 20.0)], "video_key long, duration double")
    u = spark.createDataFrame(said, "video_key long, utt_id int, start double, end double, text string")
    got = timeline.heard_and_context(u, timeline.plan_segments(v, 4.0), 4.0)
    want = []
    for k in range(5):
        own = [x for _, _, b, e, x in said if (int((b + e) / 2 // 4) if 0 <= (b + e) / 2 < 20 else 4) == k]
        near = [x for _, _, b, e, x in said if b < 4 * k + 4 and e > 4 * k]
        want.append((k, " ".join(own), " ".join(near)))
    assert rows(got, "seg_id", "heard", "context") == want


def test_utterances_need_speech(spark):
    rng = np.random.default_rng(5)
    said = [(1, i, float(b), float(b + d), " ... " if i % 9 == 0 else f" w{i} ") for i, (b, d) in enumerate(zip(rng.uniform(-2, 58, 60), rng.uniform(0.05, 6, 60), strict=True))]
    spoken = [(1, float(b), float(b + d)) for b, d in zip(rng.uniform(0, 58, 12), rng.uniform(0.05, 3, 12), strict=True)]
    raw = spark.createDataFrame(said, "video_key long, utt_id int, start double, end double, text string")
    speech = spark.createDataFrame(spoken, "video_key long, b double, e double")
    want = []
    for _, i, b, e, x in said:
        b, e = max(0.0, b), min(57.0, e)
        shared = sum(max(0.0, min(e, z) - max(b, a)) for _, a, z in spoken)
        if i % 9 and e > b and shared >= min(0.2, (e - b) / 2):
            want.append((i, x.strip()))
    assert rows(timeline.filter_utterances(raw, speech, 57.0), "utt_id", "text") == want and 5 < len(want) < 50
    assert timeline.filter_utterances(raw, speech.where("false"), 57.0).isEmpty()


def test_scalars(spark):
    assert one(spark, S.clock(F.lit(65.9))) == "01:05" and one(spark, S.clock(F.lit(3661.0))) == "01:01:01"
    assert one(spark, S.clean_answer(F.lit("<think>a\nb</think> x </think>"))) == "x"
    assert one(spark, S.first_json(F.lit('say {"a": 1} end'), "a int")["a"]) == 1
    assert one(spark, S.first_json(F.lit("none"), "a int")) is None
    assert one(spark, S.one_of(F.lit(" Bas_Droite "), S.CORNERS)) == "bas_droite" and one(spark, S.one_of(F.lit("middle"), S.CORNERS, "none")) == "none"
    assert one(spark, S.plain_name(F.lit("Élodie Çaß Šarić Ő"))) == "ELODIE CASS SARIC O" and one(spark, S.plain_name(F.lit("e\u0301"))) == "E"
    w, h = F.lit(1920), F.lit(1080)
    assert (one(spark, S.even_fit(w, w, h, 640)), one(spark, S.even_fit(h, w, h, 640))) == (640, 360)
    assert one(spark, S.even_fit(F.lit(101), F.lit(101), F.lit(3), 640)) == 100
    assert one(spark, S.turn_of(F.lit(90))) == "transpose=2" and one(spark, S.turn_of(F.lit(0))) == ""
    assert one(spark, S.first_duration(F.lit("N/A"), F.lit("-1"), F.lit("2.5"))) == 2.5
    assert one(spark, S.merged_class(F.lit("vibora"))) == "bandeja_vibora" and one(spark, S.merged_class(F.lit("incertain"))) is None


def test_jump_cuts(spark):
    rng = np.random.default_rng(6)
    m = rng.uniform(0.1, 0.5, 400)
    m[[3, 90, 140, 240, 396]] = 7.0  # spikes, two of them within two seconds
    m[200:206] = 5.0  # a movement of several frames
    m[300] = 1.4  # under the floor
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(m)], "video_key long, frame long, motion double")
    pad = np.concatenate([m[14::-1], m, m[:-16:-1]])
    want, last = [], -999
    for i in range(2, 398):
        level = max(float(np.median(pad[i : i + 31])), 0.3)
        if m[i] > 6 * level and m[i] > 1.5 and m[i] > 2.5 * max(m[i - 2], m[i - 1], m[i + 1], m[i + 2]) and i - last >= 60:
            want.append(i)
            last = i
    assert series.jump_cuts(df, 30.0).first().cuts == want == [3, 90, 240, 396]


def test_split_shots(spark):
    cuts = [7, 40, 47, 61, 118]  # the first and third keep no distance, the last leaves a short end
    df = spark.createDataFrame([(1, i, 0.9 if i in cuts else 0.1) for i in range(120)], "video_key long, frame long, dist double")
    assert rows(series.split_shots(df, 20.0), "shot_id", "start_f", "end_f") == [(0, 0, 40), (1, 40, 61), (2, 61, 120)]


def test_alternating_hits(spark):
    """The best of all series of choices, by trying them all; two sounds too close are one hit."""
    from itertools import product

    rng, rows_, want = np.random.default_rng(7), [], {}
    for v in range(12):
        t, s = np.cumsum(rng.uniform(0.5, 0.9, 6)), rng.uniform(0, 9, (6, 2))
        rows_ += [(v, i, float(t[i]), float(s[i, 0]), float(s[i, 1])) for i in range(6)]

        def worth(choice, t=t, s=s):
            hits = [i for i in range(6) if choice[i] is not None]
            if any(choice[a] == choice[b] or t[b] - t[a] < 0.45 for a, b in zip(hits, hits[1:], strict=False)):
                return -1.0
            return sum(s[i, choice[i]] for i in hits) + 3.0 * (6 - len(hits))

        want[v] = max(worth(c) for c in product((None, 0, 1), repeat=6)), worth
    df = spark.createDataFrame(rows_, "video_key long, cand int, t double, s0 double, s1 double")
    got: dict = {}
    for r in decode.alternate_hits(df).orderBy("video_key", "cand").collect():
        got.setdefault(r.video_key, []).append(r.team)
    assert all(abs(worth(got[v]) - best) < 1e-9 for v, (best, worth) in want.items())
    close = spark.createDataFrame([(1, 0, 5.0, 8.0, 0.0), (1, 1, 5.3, 0.0, 9.0)], df.schema)
    assert [r.team for r in decode.alternate_hits(close).orderBy("cand").collect()] == [None, 1]


def test_pose_rules_and_answers(spark):
    assert one(spark, F.array_join(decode.allowed_strokes(F.lit("head"), F.lit(8.0)), ",")) == "bandeja,vibora,smash"
    assert "service" not in one(spark, decode.allowed_strokes(F.lit("high"), F.lit(8.0)))
    assert one(spark, decode.allowed_strokes(F.lit("low"), F.lit(2.0))) == ["volee_cd", "volee_revers"]


def test_nearest_position(spark):
    t = spark.createDataFrame([(1, 0, 0, 1.0, 1.0), (1, 0, 1, None, None), (1, 0, 2, 3.0, 3.0), (1, 0, 9, None, None)], "shot_id long, slot int, frame long, x double, y double")
    got = decode.nearest_position(t.where("x is null"), t)
    assert rows(got, "frame", "x") == [(1, 1.0), (9, 3.0)]


def state(games, points):
    return {"games": games, "points": points}


def test_point_winner(spark):
    order, cases = ["0", "15", "30", "40"], []
    for i in range(4):  # the server's and the other's next point, within a game
        for j in range(4):
            now = state([[2], [4]], [order[i], order[j]])
            cases += [(now, state([[2], [4]], [order[i + 1], order[j]]), 0)] if i < 3 else []
            cases += [(now, state([[2], [4]], [order[i], order[j + 1]]), 1)] if j < 3 else []
            cases += [(now, state([[2], [4]], [order[i + 2], order[j]]), None)] if i < 2 else []
            cases += [(now, now, None)]
    cases += [
        (state([[0], [2]], ["40", "AD"]), state([[0], [2]], ["40", "40"]), 0),
        (state([[0], [2]], ["30", "40"]), state([[0], [3]], ["0", "0"]), 1),
        (state([[4, 5], [6, 2]], ["40", "15"]), state([[4, 6, 0], [6, 2, 0]], ["0", "0"]), 0),
        (state([[6], [6]], ["8", "7"]), state([[6], [6]], ["8", "8"]), 1),
        (state([[3], [3]], ["0", "0"]), state([[4], [4]], ["0", "0"]), None),
    ]
    kind = "struct<games: array<array<int>>, points: array<string>>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    got = [r.w for r in df.withColumn("w", score.point_winner("a", "b")).orderBy("i").collect()]
    assert got == [w for *_, w in cases]


def test_parse_and_clean_scores(spark):
    kind = "array<struct<team: string, serving: boolean, values: array<string>>>"
    good = [("a", True, ["6", " ", "15"]), ("b", False, ["3", "ad"])]
    df = spark.createDataFrame([(1, good), (2, good[:1]), (3, [good[0], ("b", False, ["x", "15"])])], f"i int, rows {kind}")
    got = {r.i: r.state for r in score.parse_rows(df).collect()}
    assert got[1].games == [[6], [3]] and got[1].points == ["15", "AD"] and got[2] is None and got[3] is None
    seq = [(1, 0, [[1], [0]]), (1, 1, [[5], [5]]), (1, 2, [[1], [1]]), (1, 3, [[2], [1]])]
    states = spark.createDataFrame([(m, o, g, ["0", "0"]) for m, o, g in seq], "match int, ord int, games array<array<int>>, points array<string>")
    assert rows(score.clean_sequence(states), "ord", "kept") == [(0, True), (1, False), (2, True), (3, True)]


def test_roles_and_half(spark):
    t = spark.createDataFrame([(1, s, f, x, 5.0 if s < 2 else 15.0) for f in range(3) for s, x in ((0, 2.0), (1, 8.0), (2, 2.0), (3, 8.0))], "shot_id long, slot int, frame long, x double, y double")
    assert rows(stats.slot_roles(t), "slot", "role") == [(0, "right"), (1, "left"), (2, "left"), (3, "right")]
    lateral, depth = S.own_half(F.lit(2.0), F.lit(4.0), F.lit(True))
    assert (one(spark, lateral), one(spark, depth)) == (8.0, 6.0)


def test_gaps_split_tracks(spark):
    known = [0, 1, 2, 16, 17, 40]
    t = spark.createDataFrame([(1, 0, i, float(i) if i in known else None, 1.0 if i in known else None) for i in range(45)], "shot_id long, slot int, frame long, x double, y double")
    got = rows(series.track_pieces(t, 15).groupBy("piece").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.count("*").alias("n")), "a", "b", "n")
    assert got == [(0, 17, 18), (40, 40, 1)]


def test_smoothing_fits_parabolas(spark):
    rng, data, want = np.random.default_rng(3), [], {}
    for slot, n in enumerate((5, 9, 10, 13, 16, 40)):
        y = rng.normal(size=n)
        data += [(1, slot, 1, f, float(1 + 2 * f - 0.3 * f * f), float(y[f])) for f in range(n)]
        w = min(15, n // 2 * 2 - 1)
        for f in range(n):
            c = min(max(f, w // 2), n - 1 - w // 2) if n >= 9 else f
            at = np.arange(c - w // 2, c + w // 2 + 1)
            want[slot, f] = np.polyval(np.polyfit(at - c, y[at], 2), f - c) if n >= 9 else y[f]
    df = spark.createDataFrame(data, "shot_id long, slot int, piece int, frame long, x double, y double")
    for r in motion.smooth_pieces(df).collect():
        assert abs(r.x - (1 + 2 * r.frame - 0.3 * r.frame**2)) < 1e-6 and abs(r.y - want[r.slot, r.frame]) < 1e-9


def test_labels_and_folds(spark):
    schema = "video string, key long, label string"
    saved = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema)
    fresh = spark.createDataFrame([("a", 1, "z"), ("a", 2, "bad")], schema)
    got = learning.upsert_labels(saved, fresh, spark.createDataFrame([("z",)], "label string"))
    assert rows(got, "video", "key", "label") == [("a", 1, "z"), ("b", 1, "y")]


def test_classifier_learns_separable_classes(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 1, (60, 20)) for m in (-2, 0, 2)])
    data = [(i, f"c{i // 60}", i % 5, x[i].tolist()) for i in range(180)]
    df = spark.createDataFrame(data, "key long, truth string, fold int, features array<double>")
    got = learning.cross_validate(df, ["c0", "c1", "c2"])
    assert got.count() == 180 and got.where("truth = pred").count() > 162


def test_colours_and_teams(spark):
    assert one(spark, stats.colour_word(F.lit(210), F.lit(40), F.lit(40))) == "rouge"
    teams = spark.createDataFrame([("GALAN/LEBRON",)], "team string")
    seen = spark.createDataFrame([(1, "A GALAN", "rouge"), (2, "DELEBRON", "bleu"), (3, "OTHER", "bleu")], "obs_id int, name string, colour string")
    assert rows(stats.team_votes(teams, seen), "colour", "votes") == [("bleu", 1), ("rouge", 1)]


def test_homography_round_trip(spark):
    h = [0.02, 0.001, -3.0, 0.0005, 0.03, -1.0, 0.00001, 0.0004, 1.0]
    x, y = stats.to_court(F.lit(300.0), F.lit(200.0), h)
    bx, by = stats.to_court(x, y, stats.inverse3(h))
    assert abs(one(spark, bx) - 300) < 1e-6 and abs(one(spark, by) - 200) < 1e-6


def test_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"video": "v", "key": "k", "labels": {"56:24:1": {"label": "smash", "annotator": "user"}}}))
    assert rows(sources.read_labels(spark, str(tmp_path / "l.json")), "video", "shot_id", "frame", "slot", "label") == [("k", 56, 24, 1, "smash")]
    (tmp_path / "match.mp4").write_bytes(b"abc")
    key = sources.video_keys(spark, str(tmp_path / "match.mp4")).first().video_key
    import hashlib

    assert key == "match-" + hashlib.sha1(b"match.mp4:3abc").hexdigest()[:12]
    report = {"format": {"duration": "N/A"}, "streams": [{"codec_type": "video", "width": 10, "height": 20, "duration": "3.5", "avg_frame_rate": "30/1", "side_data_list": [{"rotation": 90}]}]}
    (tmp_path / "p.json").write_text(json.dumps(report))
    got = sources.probe(spark, str(tmp_path / "p.json")).first()
    assert (got.duration, got.width, got.height, got.native_fps, got.has_audio, got.hdr) == (3.5, 20, 10, 30.0, False, False)
    asked = sources.ask_model(spark.createDataFrame([("a", "hi"), ("b", "x" * 99), ("c", "0")], "key string, prompt string"), lambda: lambda p: str(1 / int(p)) if p == "0" else p.upper(), 50)
    assert sorted(map(tuple, asked.collect())) == [("a", "HI", None), ("b", None, "prompt too long"), ("c", None, "ZeroDivisionError: division by zero")]


def test_tracks_follow_players(spark):
    """Each frame against the best of all assignments, in plain Python."""
    from itertools import permutations

    rng, seen = np.random.default_rng(8), []
    for f in range(60):
        for s, (x, y) in enumerate(((2.0, 4.0), (8.0, 5.0), (3.0, 15.0), (7.0, 16.0))):
            if rng.random() < 0.8:
                seen.append((1, f, float(x + np.sin(f / 9 + s) + rng.normal(0, 0.1)), float(y + np.cos(f / 7) * 2), float(rng.random())))
    seen += [(1, 30, 9.9, 1.0, 0.01), (1, 40, 0.1, 19.0, 2.0)]  # one unsure, one far off
    got = {(r.frame, r.slot): (r.x, r.y) for r in motion.track_players(spark.createDataFrame(seen, "shot_id long, frame long, x double, y double, conf double"), 30.0).collect()}
    last, want = {}, {}
    for f in range(60):
        for slots, far in (((0, 1), True), ((2, 3), False)):
            found = [(x, y) for _, g, x, y, c in sorted(seen, key=lambda r: -r[4]) if g == f and (y < 10) == far][:2]
            if not found:
                continue
            if not any(s in last for s in slots):
                pairs = list(zip(slots, sorted(found), strict=False))
            else:
                cost = lambda p: sum(np.hypot(q[0] - last[s][0], q[1] - last[s][1]) if s in last else 1.0 for s, q in p)
                pairs = min((list(zip(o, found, strict=False)) for o in permutations(slots)), key=cost)
                pairs = [(s, q) for s, q in pairs if s not in last or np.hypot(q[0] - last[s][0], q[1] - last[s][1]) <= 2.5 + 8 * (f - last[s][2]) / 30]
            for s, q in pairs:
                last[s], want[f, s] = (*q, f), q
    assert got == want


def test_late_events_are_dropped(spark, tmp_path):
    import os

    def put(name, seconds):
        spark.sql(f"SELECT 1L AS video_key, timestamp_seconds(1700000000 + s) AS ts, 't' AS text FROM (SELECT explode(array({seconds})) AS s)").coalesce(1).write.parquet(str(tmp_path / name))
        part = next(p for p in (tmp_path / name).iterdir() if p.suffix == ".parquet")
        os.makedirs(tmp_path / "in", exist_ok=True)
        part.rename(tmp_path / "in" / f"{name}.parquet")
        os.utime(tmp_path / "in" / f"{name}.parquet", (1_700_000_000 + int(name), 1_700_000_000 + int(name)))

    put("1", "0, 1, 2, 800")
    put("2", "810")
    put("3", "3, 2000")  # the first is more than ten minutes late
    put("4", "5000")
    schema = "video_key long, ts timestamp, text string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = tumbling.segment_counts(stream, "100 seconds").writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True)
    q = out.option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = sorted(r.n for r in spark.table("late").collect())
    assert got == [1, 2, 3]  # 2000, then 800 and 810, then 0 to 2 without the late one


def test_stream_equals_batch(spark, tmp_path):
    data = spark.sql("SELECT id % 3 AS video_key, timestamp_seconds(1700000000 + id * 2) AS ts, concat('t', id % 2) AS text FROM range(60)")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = tumbling.segment_counts(stream).writeStream.format("memory").queryName("seg").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = rows(spark.table("seg"), "video_key", "start", "n", "texts")
    finally:
        q.stop()
    assert got == rows(tumbling.segment_counts(data), "video_key", "start", "n", "texts")
