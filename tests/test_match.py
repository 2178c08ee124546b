"""Stores, sound and picture sources, training, and the two analyses as a whole, on small hand-made inputs."""

import sys
import wave

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from matchgrid.operators import court, report, series
from matchgrid.plans import match, training
from matchgrid.sources import media, stores
from matchgrid.sources.frames import raw_frames


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_label_store(spark, tmp_path):
    path = str(tmp_path / "labels")
    assert stores.load_labels(spark, path).isEmpty()
    schema = "video string, key string, label string, annotator string"
    stores.save_labels(spark.createDataFrame([("a", "1:2:3", "lob", "model"), ("b", "1:2:3", "smash", "user")], schema), path)
    fresh = spark.createDataFrame([("a", "1:2:3", "smash"), ("a", "9:9:0", "nothing")], "video string, key string, label string")
    known = spark.createDataFrame([("smash",), ("lob",)], "label string")
    merged = stores.import_labels(stores.load_labels(spark, path).where("video = 'a'"), fresh, known)
    stores.save_labels(spark.createDataFrame(merged.collect(), merged.schema), path)
    got = stores.load_labels(spark, path)
    assert rows(got, "video", "key", "label", "annotator") == [("a", "1:2:3", "smash", "user"), ("b", "1:2:3", "smash", "user")]
    assert rows(stores.labelled_videos(got), "video") == [("a",), ("b",)]


def test_hit_and_track_stores(spark, tmp_path):
    path = str(tmp_path / "hits")
    with pytest.raises(FileNotFoundError):
        stores.load_hits(spark, path)
    hits = spark.createDataFrame([("a", 1), ("b", 2)], "video string, frame int")
    stores.save_hits(hits, path, checked=False)
    stores.save_hits(hits.where("video = 'b'").withColumn("frame", F.lit(7)), path, checked=True)
    got = stores.load_hits(spark, path)
    assert rows(got, "video", "frame") == [("a", 1), ("b", 7)]
    tracks = spark.createDataFrame([("a", 30.0), ("b", 25.0)], "video string, fps double")
    fresh, kept = stores.load_tracks(tracks, got, 30.0)
    assert rows(fresh, "video") == rows(kept, "video") == [("a",)]


def test_feature_store_merges_and_versions(spark, tmp_path):
    path, schema = str(tmp_path / "features"), "video string, key string, features array<float>, stroke_vlm string, stroke_pose string"
    assert stores.load_features(spark, path).isEmpty()
    stores.save_features(spark.createDataFrame([("a", "1", [1.0], None, "lob"), ("b", "1", [5.0], None, "lob")], schema), path, 30.0)
    stores.save_features(spark.createDataFrame([("a", "2", [2.0], "smash", "lob")], schema), path, 30.0)
    got = stores.load_features(spark, path)
    assert rows(got, "video", "key") == [("a", "1"), ("a", "2"), ("b", "1")]
    assert stores.load_features(spark, path, version=99).isEmpty()
    labels = spark.createDataFrame([("a", "1", "vibora"), ("a", "2", "incertain"), ("c", "1", "lob")], "video string, key string, label string")
    samples, missing = stores.collect_samples(got, labels)
    assert rows(samples, "video", "key", "truth") == [("a", "1", "bandeja_vibora")] and rows(missing, "video", "n_labels") == [("c", 1)]


def samples_of(spark, per_class=60):
    rng = np.random.default_rng(0)
    data = [(f"v{i % 3}", str(i), rng.normal(c, 1, 20).tolist(), name, "lob", None) for c, name in ((-2, "lob"), (0, "smash"), (2, "pas_une_frappe")) for i in range(per_class)]
    data = [(v, f"{name}{k}", x, name, vlm, pose) for v, k, x, name, vlm, pose in data] + [("v9", "rare", [0.0] * 20, "service", None, None)]
    return spark.createDataFrame(data, "video string, key string, features array<float>, truth string, stroke_vlm string, stroke_pose string")


def test_training_and_model_store(spark, tmp_path):
    path = str(tmp_path / "model")
    assert stores.load_model(spark, path) is None and not stores.classifier_beats_model(None)
    got = training.train(samples_of(spark), path)
    assert got["meta"]["classes"] == ["lob", "pas_une_frappe", "smash"] and got["meta"]["n"] == 180
    assert got["meta"]["cv_accuracy"] > 0.9 and abs(got["meta"]["vlm_accuracy"] - 1 / 3) < 1e-9
    held = {r.video: r for r in got["held_out"].collect()}
    assert set(held) == {"v0", "v1", "v2", "(all)"} and held["(all)"].accuracy > 0.9 and held["v0"].false_hits == 20
    text = training.training_report(got)
    assert "| stroke_pose | — |" in text and "| stroke_vlm | 33 % (n=180) |" in text and "| **lob** | " in text
    model, meta = stores.load_model(spark, path)
    from matchgrid.operators.learning import predict_mlp

    x = np.array([[-2.0] * 20, [2.0] * 20])
    assert np.allclose(predict_mlp(model, x), predict_mlp(got["model"], x))
    assert [meta["classes"][i] for i in predict_mlp(model, x).argmax(1)] == ["lob", "pas_une_frappe"]
    assert stores.load_model(spark, path, version=99) is None and stores.load_model(spark, path, number=5) is None
    assert stores.classifier_beats_model(meta) and not stores.classifier_beats_model({"cv_accuracy": 0.4, "vlm_accuracy": 0.5})
    assert stores.classifier_beats_model({"cv_accuracy": 0.1, "vlm_accuracy": float("nan")})
    with pytest.raises(ValueError):
        training.train(samples_of(spark, 2))


def test_memo_and_images(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [stores.memo(spark, str(tmp_path / "m"), make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "1_2_3_impact.jpg").write_bytes(b"x")
    (tmp_path / "img" / "1_2_3.jpg").write_bytes(b"x")
    items = spark.createDataFrame([("1:2:3",), ("4:5:6",)], "key string")
    assert rows(stores.existing_images(spark, items, str(tmp_path / "img")), "key") == [("1:2:3",)]
    assert stores.existing_images(spark, items, str(tmp_path / "none")).isEmpty()


def test_wav_files(spark, tmp_path):
    x = (np.sin(np.arange(8000) / 10) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.repeat(x, 2).tobytes())
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    got = {r.path.rsplit("/", 1)[1]: r for r in media.wav_lengths(spark, str(tmp_path / "*.wav")).collect()}
    assert (got["a.wav"].rate, got["a.wav"].channels, got["a.wav"].duration) == (8000, 2, 1.0) and got["b.wav"].duration is None
    sound = media.wav_sounds(spark, str(tmp_path / "a.wav")).first()
    assert sound.rate == 8000 and np.allclose(sound.samples, x / 32768, atol=1e-6)


def test_frames_crops_and_colours(spark, tmp_path):
    frames = np.random.default_rng(0).integers(0, 256, (5, 40, 30, 3), dtype=np.uint8)
    (tmp_path / "f.rgb").write_bytes(frames.tobytes())
    df = raw_frames(spark, str(tmp_path / "f.rgb"), 30, 40, 25)
    got = {r.frame: bytes(r.pixels) for r in df.collect()}
    assert got == {i: f.tobytes() for i, f in enumerate(frames)}
    boxes = spark.createDataFrame([("a", 2, -5, 3, 10, 20), ("b", 2, 10, 10, 10, 12)], "key string, frame long, x0 int, y0 int, x1 int, y1 int")
    part = media.crops(df, boxes, 30, 40).collect()
    assert [(r.key, r.w, r.h) for r in part] == [("a", 10, 17)] and bytes(part[0].pixels) == frames[2, 3:20, 0:10].tobytes()
    kpts = [(0.0, 0.0, 0.0)] * 17
    for k, xy in {5: (5, 10), 6: (25, 10), 11: (5, 30), 12: (25, 30)}.items():
        kpts[k] = (float(xy[0]), float(xy[1]), 0.9)
    pose = spark.createDataFrame([("a", 1, kpts), ("b", 1, [(0.0, 0.0, 0.1)] * 17)], "key string, frame long, kpts array<struct<x: double, y: double, c: double>>")
    c = media.mean_colours(media.crops(df, media.torso_boxes(pose), 30, 40)).collect()
    assert len(c) == 1 and np.allclose((c[0].r, c[0].g, c[0].b), frames[1, 14:26, 9:21].reshape(-1, 3).mean(axis=0))


def test_row_of_court_depth(spark):
    # Rows of a pinhole picture: v = v0 + k / (y0 - y) with depth y.
    v = lambda y: 120 + 9000 / (35 - y)
    got = spark.range(21).select("id", court.row_of(F.col("id").cast("double"), F.lit(v(16.95)), F.lit(v(10.0)), F.lit(120.0)).alias("row")).collect()
    assert all(abs(r.row - v(r.id)) < 1e-6 for r in got)


def test_short_series_are_mirrored(spark):
    m = [0.3, 0.3, 9.0, 0.3, 0.3, 0.4]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(m)], "video_key long, frame long, motion double")
    assert series.jump_cuts(df, 30.0).first().cuts == [2]
    flat = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((0, 1, 5, 5, 1, 0, 7, 0, 3, 3))], "key long, i long, v double")
    assert series.pick_peaks(flat, 1.0, 1).first().peaks == [2, 6]


def state(games, points):
    return {"games": games, "points": points}


def recorded(first, swings, colours, seed):
    """Tables of one match whose rally is shot ``first``: a sound with a click at each swing, poses, tracks and shirts."""
    rate, fps = 22050.0, 30.0
    sound = np.random.default_rng(seed).normal(0, 1e-3, int(4 * rate))
    poses, tracks, shirts = [], [], []
    for f in swings:
        k = int(f / fps * rate)
        sound[k : k + 400] += np.sin(2 * np.pi * 3000 * np.arange(400) / rate) * np.exp(-np.arange(400) / 80)
    for f in range(120):
        for s in range(4):
            x, y = 200.0 + 100 * s, 300.0
            p = [[x, y, 0.9] for _ in range(17)]
            for k, (dx, dy) in {0: (0, 0), 5: (-20, 50), 6: (20, 50), 9: (-35, 110), 10: (40, 110), 11: (-15, 110), 12: (15, 110), 15: (-15, 200), 16: (15, 200)}.items():
                p[k] = [x + dx, y + dy, 0.9]
            p[10][0] += f % 2  # a tremor of one pixel
            for hit, slot in swings.items():
                if slot == s and hit - 2 <= f <= hit + 2:
                    p[10][1] -= 20 * (f - hit + 3)
            poses.append((first, s, f, [tuple(map(float, q)) for q in p]))
            tracks.append((first, s, f, 3.0 if s % 2 == 0 else 7.0, 5.0 if s < 2 else 15.0))
            shirts.append((first, s, *colours[s < 2]))
    match_ = f"m{first}"
    shots = [(match_, match_, first, 10.0, 14.0, "main", False), (match_, match_, first + 1, 14.0, 20.0, "main", True), (match_, match_, first + 2, 20.0, 30.0, "other", False)]
    states = [(match_, first, 0, [[1], [0]], ["0", "0"]), (match_, first, 1, [[1], [0]], ["0", "15"])]
    return {"shots": shots, "sounds": [(first, rate, sound.tolist())], "poses": poses, "tracks": tracks, "colours": shirts, "states": states}


SCHEMAS = {
    "shots": "match string, video_key string, shot_id long, start double, end double, kind string, replay boolean", "sounds": "shot_id long, rate double, samples array<double>",
    "poses": "shot_id long, slot int, frame long, kpts array<struct<x: double, y: double, c: double>>", "tracks": "shot_id long, slot int, frame long, x double, y double",
    "colours": "shot_id long, slot int, r double, g double, b double", "states": "match string, shot_id long, part int, games array<array<int>>, points array<string>",
    "teams": "match string, pos int, team string", "readings": "match string, obs_id int, name string, colour string",
}
RED, BLUE, DARK, WHITE = (200.0, 50.0, 45.0), (40.0, 70.0, 190.0), (40.0, 40.0, 45.0), (230.0, 225.0, 230.0)


def analysed(spark, *matches):
    rows = {k: [r for m in matches for r in m[k]] for k in matches[0]}
    return match.analyse(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}, fps=30.0)


def first_match():
    teams = [("m1", 0, "BLUE/ONES"), ("m1", 1, "RED/TWOS")]
    readings = [("m1", 1, "A TWOS", "rouge"), ("m1", 2, "B TWOS", "orange"), ("m1", 3, "C ONES", "rouge")]
    return recorded(1, {30: 0, 60: 3, 90: 1}, {True: RED, False: BLUE}, 1) | {"teams": teams, "readings": readings}


def second_match():
    """Other colours, of which those of the first match lie between."""
    teams = [("m11", 0, "DARK/ONES"), ("m11", 1, "WHITE/TWOS")]
    return recorded(11, {25: 2, 55: 1, 85: 3}, {True: WHITE, False: DARK}, 2) | {"teams": teams, "readings": [("m11", 1, "D TWOS", "blanc")]}


@pytest.fixture(scope="module")
def alone(spark):
    return analysed(spark, first_match())


def test_analyse_a_match(alone):
    got = alone
    hits = got["hits"].orderBy("t").collect()
    assert [(h.slot, h.player, h.arm) for h in hits] == [(0, "RED/TWOS · right", "right"), (3, "BLUE/ONES · right", "right"), (1, "RED/TWOS · left", "right")]
    assert all(abs(h.t - 10 - f / 30) < 0.1 and abs(h.frame - f) <= 6 for h, f in zip(hits, (30, 60, 90), strict=True)) and hits[0].team_short == "Red"
    assert rows(got["rallies"], "shot_id", "winner", "n_hits", "after") == [(1, "RED/TWOS", 3, "BLUE/ONES 1 [0] · RED/TWOS 0 [15]")]
    stats = {r.player: r for r in got["stats"].collect()}
    assert len(stats) == 4 and all(r.frames == 120 and r.distance_m == 0.0 for r in stats.values())
    text = got["report"].first().markdown
    assert "points known to be won: 1" in text and "| RED/TWOS · right | 1 | 0 m |" in text and "3 shots, rallies: 1" in text and "point for RED/TWOS" in text


def test_two_matches_in_one_call(spark, alone):
    """The rows of the first match are those of it alone; the second has its own teams and colours."""
    both = analysed(spark, first_match(), second_match())
    for name, df in both.items():
        where = F.col("shot_id") < 10 if "shot_id" in df.columns else F.col("match") == "m1"
        key = lambda r: str(r)
        assert sorted(df.where(where).collect(), key=key) == sorted(alone[name].select(*df.columns).collect(), key=key), name
    assert [(h.slot, h.player) for h in both["hits"].where("match = 'm11'").orderBy("t").collect()] == [(2, "DARK/ONES · left"), (1, "WHITE/TWOS · left"), (3, "DARK/ONES · right")]
    assert both["rallies"].where("match = 'm11'").first().winner == "WHITE/TWOS"


# Tasks have no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """A client that notes each prompt in a folder, as tasks run in processes of their own."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        import os
        import uuid

        def ask(prompt):
            if "fails" in prompt:
                raise ValueError("no")
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
            return f" answer of {len(prompt.splitlines())} "

        return ask

    def prompts(self):
        import os

        return sorted(open(os.path.join(self.folder, n)).read() for n in os.listdir(self.folder))


def test_describe_a_video(spark, tmp_path):
    videos = spark.createDataFrame([(1, "clip", 12.0, "h264")], "video_key long, name string, duration double, codec string")
    heard = spark.createDataFrame([(1, 1, 0.5, 3.0, "hello"), (1, 2, 4.0, 7.0, "there"), (1, 3, 9.0, 9.5, "unspoken"), (1, 4, 1.0, 2.0, " ... ")], "video_key long, utt_id int, start double, end double, text string")
    speech = spark.createDataFrame([(1, 0.4, 7.0)], "video_key long, b double, e double")
    got = match.describe(videos, heard, speech, Counting(str(tmp_path)), {"vlm": "m"})
    doc = got["documents"].first().document
    assert list(doc.asDict()) == ["schema_version", "video", "config", "models", "audio", "transcript", "segments", "summary", "timings", "extensions"]
    assert [(s.seg_id, s.heard, len(s.frames)) for s in doc.segments] == [(0, "hello", 5), (1, "there", 5), (2, "", 2)]
    assert doc.summary == " answer of 4 " and len(doc.transcript) == 2 and doc.segments[0].seen == "answer of 2"
    assert (doc.video.name, doc.video.key, doc.video.codec, doc.video.hdr) == ("clip", "1", "h264", None)
    text = got["markdown"].first().markdown
    assert text.startswith("# Timeline of clip\n\nLength 00:12; model `m`; 1 frames a second in segments of 5 s\n\n## Summary\n\n answer of 4 \n\n## Segments\n\n### 00:00 – 00:05\n\n**Seen:** answer of 2\n\n**Heard:** hello\n")
    json = report.document_json(got["documents"]).first().json
    assert '"language":null' in json and '"schema_version":"1.0"' in json


def test_each_prompt_is_asked_once(spark, tmp_path):
    """Two videos, one of them long: a call a segment, a chunk and a video, and none in a second run."""
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    videos = spark.createDataFrame([(1, "short", 12.0), (2, "long", 33.0)], "video_key long, name string, duration double")
    heard = spark.createDataFrame([(1, 1, 0.5, 3.0, "hello"), (2, 2, 4.0, 7.0, "there")], "video_key long, utt_id int, start double, end double, text string")
    speech = spark.createDataFrame([(1, 0.4, 7.0), (2, 3.0, 9.0)], "video_key long, b double, e double")
    client = Counting(str(calls))

    def run():
        got = match.describe(videos, heard, speech, client, {"vlm": "m"}, store=store, chunk=3)
        return [sorted(map(str, got[k].collect())) for k in ("segments", "documents", "markdown")]

    first = run()
    prompts = client.prompts()
    kinds = [sum(p.startswith(k) for p in prompts) for k in ("Describe", "Summarize this part", "Summarize this timeline")]
    # Segments of equal prompts (none differs but by its time) are asked once: 3 and 7, of which two begin alike at 0 and 5 s.
    distinct = len({(s, e, c) for d, c in ((12.0, {0: "hello"}), (33.0, {0: "there", 1: "there"})) for s, e, c in [(t, min(t + 5, d), c.get(t // 5, "")) for t in range(0, int(d), 5)]})
    assert kinds == [distinct, 3, 2] and len(prompts) == len(set(prompts))
    long = next(p for p in prompts if p.startswith("Summarize this timeline") and "\n\n" in p)
    assert [line.split("] ")[0] for line in long.split("\n", 1)[1].split("\n\n")] == ["[00:00–00:15", "[00:15–00:30", "[00:30–00:33"]
    assert run() == first and client.prompts() == prompts


def test_answers_are_kept_and_failures_asked_again(spark, tmp_path):
    from matchgrid.sources.answers import asked_once, stored

    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    client = Counting(str(calls))
    prompts = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two\nlines"), ("d", "this fails"), ("e", None), ("f", "too long" * 9)], "key string, prompt string")
    for turns in (1, 3):
        got = {r.key: (r.answer, r.error) for r in asked_once(prompts, store, client, "m", most_chars=50, turns=turns).collect()}
        assert got == {"a": (" answer of 1 ", None), "b": (" answer of 1 ", None), "c": (" answer of 2 ", None), "d": (None, "ValueError: no"), "e": (None, None), "f": (None, "prompt too long")}
        assert client.prompts() == ["one", "two\nlines"] and stored(spark, store).count() == 2
    assert asked_once(prompts.where("key = 'a'"), store, client, "other").first().answer == " answer of 1 " and client.prompts() == ["one", "one", "two\nlines"]
    assert asked_once(prompts.where("false"), store, client).collect() == []


def test_team_sides(spark):
    point = "struct<r: double, g: double, b: double>"
    centres = spark.createDataFrame([("m", (0.0, 0.0, 0.0), (255.0, 255.0, 255.0)), ("n", (0.0, 0.0, 0.0), (20.0, 20.0, 20.0))], f"match string, c0 {point}, c1 {point}")
    sides = [("m", 1, "far", 10.0, 10.0, 10.0), ("m", 1, "near", 200.0, 200.0, 200.0), ("m", 2, "far", 220.0, 220.0, 220.0), ("m", 2, "near", 30.0, 30.0, 30.0), ("m", 3, "far", None, None, None), ("m", 3, "near", 5.0, 5.0, 5.0), ("n", 4, "far", 19.0, 19.0, 19.0), ("n", 4, "near", 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(sides, "match string, shot_id long, side string, r double, g double, b double")
    shirts = spark.createDataFrame([("m", 0, "A"), ("m", 1, "B"), ("n", 0, "C"), ("n", 1, "D")], SCHEMAS["teams"])
    assert rows(match.team_sides(df, centres, shirts).where("side = 'far'"), "shot_id", "team") == [(1, "A"), (2, "B"), (3, "A"), (4, "D")]


def test_shots_by_answers(spark, tmp_path):
    shots = spark.createDataFrame([("v", 1, ["a"]), ("v", 2, ["b"]), ("v", 3, ["c"]), ("w", 1, ["d"])], "video_key string, shot_id long, keyframes array<string>")
    answers = {"a": '<think>?</think> {"type": " Main", "replay": false, "scoreboard": true}', "b": "no idea", "c": '{"type": "moon", "replay": true}', "d": '{"type": "close_up"}'}
    client = lambda: lambda p: next(a for k, a in answers.items() if f": {k}. Its" in p)
    got = rows(match.shots_by_answers(shots, client, str(tmp_path / "store")), "video_key", "shot_id", "kind", "replay", "scoreboard")
    assert got == [("v", 1, "main", False, True), ("v", 2, "other", False, False), ("v", 3, "other", True, False), ("w", 1, "close_up", False, False)]


def test_command_line(spark, capsys, tmp_path):
    from matchgrid.__main__ import main

    main(["queries"])
    assert "hits_detected" in capsys.readouterr().out.split()
    still = np.random.default_rng(1).integers(0, 256, (2, 6, 8, 3), dtype=np.uint8)
    (tmp_path / "v.rgb").write_bytes(np.repeat(still, 70, axis=0).tobytes())
    out = str(tmp_path / "out")
    main(["signals", str(tmp_path / "v.rgb"), out, "--width", "8", "--height", "6", "--fps", "30"])
    assert rows(spark.read.parquet(out + "/shots"), "start_f", "end_f") == [(0, 70), (70, 140)]
