"""Query registry of the match and timeline operators.

Each query applies operators to the adapter views of the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.functions import scalars as S
from matchgrid.operators import court, decode, hits, learning, media, motion, pixels, report, score, series, stats, timeline
from matchgrid.plans import adapters as A
from matchgrid.plans import match
from matchgrid.plans import oracles
from matchgrid.session import table, written
from matchgrid.sources import stores
from matchgrid.streaming import tumbling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MERGED_CLASSES = ["c0", "c1", "c2"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _event_videos(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select(F.col("user_id").alias("video_key")).distinct()
    return users.withColumn("duration", F.lit(A.MATCH_S))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.plan_segments(_event_videos(spark, sf), A.SEGMENT_S)


@query
def timeline_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = timeline.heard_and_context(A.utterances(spark, sf), _segments(spark, sf), A.SEGMENT_S)
    return out.where("heard <> '' OR context <> ''").select("video_key", "seg_id", "start", "end", "heard", "context")


@query
def segment_plan(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.plan_segments(A.videos(spark, sf), 5.0)


@query
def frame_assignment(spark: SparkSession, sf: str) -> DataFrame:
    v = A.videos(spark, sf)
    frames = timeline.assign_frames(timeline.frame_grid(v, 1.0), timeline.plan_segments(v, 5.0), 5.0)
    return frames.groupBy("video_key", "seg_id").agg(
        F.count("*").alias("n_frames"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )


@query
def utterance_filter(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.utterances(spark, sf).withColumn("text", F.expr("if(utt_id % 7 = 0, ' ... ', text)"))
    # Off the grid of seconds, so that no time lies between two roundings.
    raw = raw.withColumns({"start": F.col("start") + 0.0003, "end": F.col("end") + 0.0003})
    return timeline.filter_utterances(raw, A.speech(spark, sf), 360.0)


def _described(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All videos described by a stub of a model, which answers with the length of the prompt."""
    spoken = A.utterances(spark, sf)
    videos = spoken.select("video_key").distinct().withColumns({"name": F.col("video_key").cast("string"), "duration": F.lit(A.MATCH_S)})
    # Off the grid of seconds, so that no time lies between two roundings.
    off = spoken.withColumns({"start": F.col("start") + 0.0003, "end": F.col("end") + 0.0003})
    return match.describe(videos, off, A.speech(spark, sf), lambda: lambda prompt: f"{len(prompt)} characters", {"vlm": "stub"})


@query
def segments_described(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark, sf)["segments"].select("video_key", "seg_id", "heard", "seen")


@query
def summaries_described(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark, sf)["summaries"]


@query
def pixel_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 21 pixels, three bytes each, of the first 63 numbers of a vector."""
    value = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 400 + 128))).cast("int")
    text = F.array_join(F.transform(F.slice("embedding", 1, 63), lambda x: F.lpad(F.hex(value(x)), 2, "0")), "")
    frames = table(spark, sf, "embeddings").select(F.expr("vec_id div 128").alias("video_key"), F.col("vec_id").alias("frame"), F.unhex(text).alias("pixels"))
    s = pixels.frame_signals(pixels.with_halo(frames))
    return s.select("video_key", "frame", F.bround("dist", 6).alias("dist"), F.bround("motion", 6).alias("motion"))


@query
def timeline_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = timeline.heard_and_context(A.utterances(spark, sf), _segments(spark, sf), A.SEGMENT_S)
    return timeline.timeline_text(out.where("heard <> ''").withColumn("seen", F.expr("if(seg_id % 3 = 0, NULL, context)")))


@query
def timeline_documents(spark: SparkSession, sf: str) -> DataFrame:
    out = timeline.heard_and_context(A.utterances(spark, sf), _segments(spark, sf), A.SEGMENT_S)
    doc = timeline.timeline_document(out)
    return doc.select("video_key", F.posexplode("segments").alias("pos", "s")).select("video_key", "pos", "s.seg_id", "s.heard").where("heard <> ''")


@query
def summary_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.summary_chunks(_segments(spark, sf)).groupBy("video_key", "chunk").agg(F.count("*").alias("n"), F.max("end").alias("until"))


@query
def model_plan(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.model_plan(A.videos(spark, sf), 1.0, 5.0, 640, 10.45).withColumn("peak_gb", F.bround("peak_gb", 4))


@query
def talk_time(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.talk_time(A.speech(spark, sf))


@query
def clock_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", S.clock(F.col("o_totalprice") / 16).alias("clock"))


@query
def answer_json(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr(
        "concat('<think>', role, ' \\n {', turn, '}</think> ok ', if(turn % 5 = 4, '{broken', concat('{\"type\": \"', role, '\", \"n\": ', turn, '}')), ' </think>')"
    )
    clean = table(spark, sf, "conversations").select("conv_id", "turn", S.clean_answer(text).alias("clean"))
    j = S.first_json("clean", "type string, n int")
    kind = S.one_of(j["type"], ("user", "assistant"), "other")
    return clean.select("conv_id", "turn", "clean", kind.alias("kind"), j["n"].cast("int").alias("n"))


@query
def probe_fields(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("value"))
    dur = S.first_duration(F.expr("if(event_id % 4 = 0, 'N/A', k)"), F.col("value").cast("string"))
    return ev.select("event_id", dur.alias("duration"), S.turn_of(F.expr("cast(event_id % 4 * 90 AS int)")).alias("turn"))


@query
def text_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    key = F.concat(S.file_slug(F.concat("source", F.lit(" _é:"), "lang")), F.lit("-"), F.substring(F.sha1(F.concat("source", F.lit(":"), F.octet_length("text").cast("string"), "text")), 1, 12))
    return d.select("doc_id", key.alias("file_key"))


@query
def plain_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.plain_name("text").alias("name"))


@query
def frame_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = series.histogram_distance(A.signals(spark, sf))
    return out.select("video_key", "frame", F.bround("dist", 6).alias("dist"), F.bround("motion", 6).alias("motion"))


def _motion(spark: SparkSession, sf: str) -> DataFrame:
    """A motion series with spikes, from the events of each user in order."""
    return table(spark, sf, "events").selectExpr(
        "user_id AS video_key", "event_id AS frame", "if(event_id % 97 = 0, 9D, value / 490D) AS motion"
    )


def _dist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("user_id AS video_key", "event_id AS frame", "value / 490D AS dist")


@query
def jump_cuts(spark: SparkSession, sf: str) -> DataFrame:
    cuts = series.jump_cuts(_motion(spark, sf), 30.0)
    return cuts.select("video_key", F.explode("cuts").alias("cut"))


@query
def split_shots(spark: SparkSession, sf: str) -> DataFrame:
    extra = series.jump_cuts(_motion(spark, sf), 30.0)
    return series.split_shots(_dist(spark, sf), 30.0, 0.9, 0.6, extra)


@query
def shot_motion(spark: SparkSession, sf: str) -> DataFrame:
    shots = series.split_shots(_dist(spark, sf), 30.0, 0.9)
    return series.shot_motion(shots, _motion(spark, sf)).withColumn("motion", F.bround("motion", 6))


@query
def shot_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return series.keyframes(series.split_shots(_dist(spark, sf), 30.0, 0.9))


@query
def track_gaps(spark: SparkSession, sf: str) -> DataFrame:
    out = series.track_pieces(A.tracks(spark, sf), 3)
    return out.select("shot_id", "slot", "frame", "piece", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


@query
def track_median(spark: SparkSession, sf: str) -> DataFrame:
    out = series.median5(series.track_pieces(A.tracks(spark, sf), 3))
    return out.select("shot_id", "slot", "frame", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


@query
def player_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.player_stats(motion.smooth_tracks(A.tracks(spark, sf), 3), 30.0)


@query
def player_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return stats.heatmap(motion.smooth_tracks(A.tracks(spark, sf), 3))


@query
def slot_presence(spark: SparkSession, sf: str) -> DataFrame:
    return stats.presence(A.tracks(spark, sf)).withColumn("presence", F.bround("presence", 6))


@query
def slot_roles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.slot_roles(A.tracks(spark, sf))


@query
def speed_peaks(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").selectExpr("user_id AS key", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i", "value AS v")
    return series.pick_peaks(s, 100.0, 4).select("key", F.explode("peaks").alias("i"))


@query
def hit_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return decode.alternate_hits(A.candidates(spark, sf))


@query
def nearest_positions(spark: SparkSession, sf: str) -> DataFrame:
    t = A.tracks(spark, sf)
    out = decode.nearest_position(t.where("x is null"), t)
    return out.select("shot_id", "slot", "frame", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


@query
def strongest_slots(spark: SparkSession, sf: str) -> DataFrame:
    speeds = A.shot_rows(spark, sf).selectExpr(
        "l_orderkey div 400 AS shot_id", "cast(l_linenumber % 4 AS int) AS slot", "l_partkey % 300 AS frame", "l_quantity AS speed"
    ).groupBy("shot_id", "slot", "frame").agg(F.max("speed").alias("speed"))
    cands = table(spark, sf, "orders").selectExpr("o_orderkey div 400 AS shot_id", "o_orderkey AS cand", "(o_custkey % 80) / 8D AS t")
    return decode.strongest_slot(cands, speeds, 30.0)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with measured columns, from lineitem."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS hit_id", "l_linenumber AS n", "l_quantity / 5D AS dist", "l_discount * 6D AS speed", "l_tax * 30D AS since_start",
        "l_returnflag = 'A' AS overhead", "l_partkey % 2 = 0 AS forehand", "l_linenumber = 1 AS first_in_shot", "l_suppkey % 3 > 0 AS wrist_low",
        "element_at(array('low', 'high', 'head'), cast(l_partkey % 3 AS int) + 1) AS height",
        "if(l_suppkey % 4 = 0, NULL, l_suppkey % 4 > 1) AS swing", "l_quantity / 4D AS evidence",
        "element_at(array('service', 'revers', 'smash', 'lob', 'tennis', NULL), cast(l_suppkey % 6 AS int) + 1) AS answer",
    )


@query
def stroke_rules(spark: SparkSession, sf: str) -> DataFrame:
    return decode.stroke_by_pose(_hits(spark, sf)).select("hit_id", "n", "stroke", "confidence")


@query
def strokes_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("hit_id", "n", F.array_join(decode.allowed_strokes("height", "dist"), ",").alias("allowed"), S.zone("dist").alias("zone"))


@query
def strokes_refined(spark: SparkSession, sf: str) -> DataFrame:
    out = decode.refine_with_answers(decode.stroke_by_pose(_hits(spark, sf)))
    return out.select("hit_id", "n", "stroke", "confidence", "stroke_model")


@query
def strokes_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    h = decode.stroke_by_pose(_hits(spark, sf)).withColumnsRenamed({"stroke": "stroke_pose", "answer": "stroke_model"})
    return decode.reconcile(h).select("hit_id", "n", "stroke")


@query
def strokes_classified(spark: SparkSession, sf: str) -> DataFrame:
    h = decode.stroke_by_pose(_hits(spark, sf)).withColumns({
        "label": F.expr("case cast(dist as int) % 4 when 0 then 'pas_une_frappe' when 1 then 'bandeja_vibora' when 2 then 'lob' end"),
        "prob": F.col("speed") * 2, "stroke_model": F.col("answer"),
    })
    return decode.apply_classifier(h).select("hit_id", "n", "stroke", F.bround("confidence", 6).alias("confidence"))


@query
def stroke_counts(spark: SparkSession, sf: str) -> DataFrame:
    h = decode.stroke_by_pose(_hits(spark, sf)).withColumn("player", F.col("n"))
    return stats.stroke_counts(h, ("service", "coup_droit", "bandeja_vibora", "smash", "volee_cd"))


@query
def score_readings(spark: SparkSession, sf: str) -> DataFrame:
    rows = (
        "array(named_struct('team', concat(' t', o_custkey % 3), 'serving', o_orderkey % 2 = 0, 'values', array(cast(o_orderkey % 7 AS string), ' ', if(o_orderkey % 11 = 0, 'x', '3'), ' ad')),"
        " named_struct('team', 'B', 'serving', o_orderkey % 2 = 1, 'values', if(o_orderkey % 13 = 0, array('1'), array('2', cast(o_custkey % 7 AS string), '40'))))"
    )
    r = table(spark, sf, "orders").select("o_orderkey", F.expr(rows).alias("rows"))
    s = score.parse_rows(r)
    return s.select(
        "o_orderkey", F.array_join("state.teams", "|").alias("teams"),
        F.expr("array_join(transform(state.games, g -> array_join(g, '-')), '|')").alias("games"), F.array_join("state.points", "|").alias("points"),
    )


@query
def score_clean(spark: SparkSession, sf: str) -> DataFrame:
    return score.clean_sequence(A.score_states(spark, sf)).select("match", "ord", "kept")


@query
def point_winners(spark: SparkSession, sf: str) -> DataFrame:
    return score.point_winners(A.score_states(spark, sf))


@query
def score_stories(spark: SparkSession, sf: str) -> DataFrame:
    return score.last_score(A.score_states(spark, sf))


@query
def label_upsert(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    saved = d.where("doc_id % 3 <> 0").selectExpr("source AS video", "doc_id AS key", "lang AS label")
    fresh = d.where("doc_id % 4 = 0").selectExpr("source AS video", "doc_id AS key", "if(doc_id % 8 = 0, 'en', 'xx') AS label")
    known = d.where("lang <> 'xx'").selectExpr("lang AS label").distinct()
    return learning.upsert_labels(saved, fresh, known)


@query
def labels_open(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").selectExpr("source AS video", "doc_id AS key")
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").selectExpr("source AS video", "doc_id AS key", "'c' AS label", "if(doc_id % 3 = 0, 'model', 'user') AS annotator")
    return learning.unlabelled_hits(d, labels).groupBy("video").agg(F.count("*").alias("n"), F.max("key").alias("last"))


@query
def label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return learning.accuracy(A.labelled(spark, sf), "pred", "vlm", "pose").withColumn("accuracy", F.bround("accuracy", 6))


@query
def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return learning.confusion(A.labelled(spark, sf), MERGED_CLASSES)


@query
def label_held_out(spark: SparkSession, sf: str) -> DataFrame:
    out = learning.held_out(A.labelled(spark, sf), "c0", 15)
    return out.withColumns({"accuracy": F.bround("accuracy", 6), "stroke_accuracy": F.bround("stroke_accuracy", 6)})


@query
def label_folds(spark: SparkSession, sf: str) -> DataFrame:
    return learning.folds(A.labelled(spark, sf), 5).select("key", "fold")


@query
def label_weights(spark: SparkSession, sf: str) -> DataFrame:
    return learning.class_weights(A.labelled(spark, sf)).withColumn("weight", F.bround("weight", 6))


@query
def hit_precision(spark: SparkSession, sf: str) -> DataFrame:
    return learning.hit_precision(A.labelled(spark, sf), "c0").withColumn("precision", F.bround("precision", 6))


@query
def label_selection(spark: SparkSession, sf: str) -> DataFrame:
    names = "element_at(array('bandeja', 'vibora', 'lob', 'smash', '', 'incertain'), cast({} % 6 AS int) + 1)"
    rows = A.labelled(spark, sf).selectExpr(
        "video", "key", "pred AS stroke", "key % 17 / 17 AS clf_prob",
        *[f"{names.format(x)} AS stroke_{c}" for c, x in (("pose", "key"), ("vlm", "(key div 6)"), ("clf", "(key div 36)"))],
    )
    return learning.select_for_annotation(rows, 40, rows.where("key % 11 = 0"))


@query
def label_references(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.labelled(spark, sf).selectExpr("video", "key", "element_at(array('incertain', 'pas_une_frappe', 'lob', 'smash', 'service'), cast(key % 5 AS int) + 1) AS label", "if(key % 2 = 0, 'model', 'user') AS annotator")
    return learning.references(rows)


@query
def colour_words(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").selectExpr("p_partkey", "p_partkey * 7 % 256 AS r", "p_partkey * 13 % 256 AS g", "p_partkey * 29 % 256 AS b")
    return p.select("p_partkey", stats.colour_word("r", "g", "b").alias("colour"))


@query
def colour_clusters(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").selectExpr("p_partkey % 9 AS match", "cast(p_partkey * 7 % 256 AS double) AS r", "cast(p_partkey * 13 % 256 AS double) AS g", "cast(p_size * 5 AS double) AS b")
    c = stats.two_means(p)
    return c.select("match", *[F.bround(f"{k}.{x}", 4).alias(f"{k}_{x}") for k in ("c0", "c1") for x in "rgb"])


@query
def team_votes(spark: SparkSession, sf: str) -> DataFrame:
    teams = table(spark, sf, "nation").selectExpr("n_name AS team")
    seen = table(spark, sf, "nation").selectExpr(
        "n_nationkey AS obs_id", "if(n_nationkey % 2 = 0, concat('X ', n_name), concat('DE', n_name)) AS name", "if(n_nationkey % 3 = 0, 'rouge', 'bleu') AS colour"
    )
    return stats.team_votes(teams, seen)


@query
def court_points(spark: SparkSession, sf: str) -> DataFrame:
    h = [0.02, 0.001, -3.0, 0.0005, 0.03, -1.0, 0.00001, 0.0004, 1.0]
    p = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity * 20D AS px", "l_discount * 3000D AS py")
    x, y = stats.to_court(F.col("px"), F.col("py"), h)
    p = p.withColumns({"x": x, "y": y})
    bx, by = stats.to_court(F.col("x"), F.col("y"), stats.inverse3(h))
    inside = court.on_court("x", "y")
    return p.select("l_orderkey", "l_linenumber", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"), F.bround(bx, 3).alias("px"), F.bround(by, 3).alias("py"), inside.alias("inside"))


@query
def court_line_rows(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _line_pieces(spark, sf)
    expected = pieces.select("video_key").distinct().selectExpr("video_key", "200D + video_key % 100 AS v", "150D AS lo", "350D AS hi")
    return court.line_rows(pieces, expected).select("video_key", "row", F.bround("total", 4).alias("total"))


@query
def court_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Maps through four corners, the corners of the court and the way there and back."""
    point = lambda a, b: f"named_struct('x', cast({a} AS double), 'y', cast({b} AS double))"
    p = table(spark, sf, "part").selectExpr(
        "p_partkey",
        "array(" + ", ".join([point("400 + p_partkey % 61", "200 + p_size % 7"), point("880 - p_partkey % 53", "203 + p_partkey % 5"), point("1150 + p_size", "600 + p_partkey % 37"), point("130 - p_size", "590 + p_partkey % 41")]) + ") AS corners",
        "500D + p_partkey % 211 AS px", "300D + p_partkey % 97 AS py",
    )
    m = court.fit_maps(p).withColumn("image", court.image_corners())
    x, y = court.mapped("h", F.col("px"), F.col("py"))
    m = m.withColumns({"x": x, "y": y})
    bx, by = court.mapped(court.inverse(court.nine(F.col("h"))), F.col("x"), F.col("y"))
    return m.select("p_partkey", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"), F.bround(bx, 5).alias("px"), F.bround(by, 5).alias("py"),
                    F.bround(F.col("image")[2]["x"], 4).alias("near_x"), F.bround(F.col("image")[2]["y"], 4).alias("near_y"))


def _shots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS video_key", "o_orderkey AS shot_id", "o_orderkey * 10D AS start", "cast(o_totalprice AS bigint) % 600 * 1D AS duration",
        "if(o_orderstatus = 'F', 'main', 'other') AS kind", "o_orderkey % 4 > 0 AS scoreboard", "o_orderkey % 9 = 0 AS replay",
    )


@query
def longest_shots(spark: SparkSession, sf: str) -> DataFrame:
    return stats.longest(_shots(spark, sf), 6).select("video_key", "shot_id", "duration", "rank")


@query
def calibration_times(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sample_times(_shots(spark, sf)).withColumn("t", F.bround("t", 6))


@query
def overlay_replays(spark: SparkSession, sf: str) -> DataFrame:
    return stats.replay_by_overlay(_shots(spark, sf)).select("video_key", "shot_id", "replay")


@query
def overlay_times(spark: SparkSession, sf: str) -> DataFrame:
    s = _shots(spark, sf).withColumn("end", F.col("start") + 5)
    return stats.last_overlay(s.where("kind = 'main'").select("video_key", "shot_id", "start", "end"), s.where("kind <> 'main'").select("video_key", "shot_id", "start", "end"), 1e9)


@query
def shot_kinds(spark: SparkSession, sf: str) -> DataFrame:
    s = _shots(spark, sf).withColumn("rally", stats.is_rally())
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("rally").alias("rallies"))


@query
def hit_boxes(spark: SparkSession, sf: str) -> DataFrame:
    kpts = "transform(sequence(0, 16), k -> named_struct('x', p_size * (k + 1) * 1D, 'y', (p_partkey * (k + 3) % 91) * 1D, 'c', (p_partkey * (k + 1) % 10) / 10D))"
    p = table(spark, sf, "part").selectExpr("p_partkey AS key", f"{kpts} AS kpts")
    fx, fy = media.feet("kpts", F.lit(-1.0), F.lit(-2.0))
    box = media.hit_boxes(p).join(p.select("key", F.bround(fx, 6).alias("foot_x"), F.bround(fy, 6).alias("foot_y")), "key")
    return box.select("key", *[F.bround(c, 6).alias(c) for c in ("cx", "cy", "side")], "foot_x", "foot_y")


@query
def shirt_colours(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 400 AS shot_id", "l_linenumber % 4 AS slot", "l_partkey * 7 % 256 * 1D AS r", "l_suppkey * 13 % 256 * 1D AS g", "l_quantity AS b"
    )
    return media.side_colours(media.slot_colours(p)).select("shot_id", "side", *[F.bround(c, 6).alias(c) for c in "rgb"])


@query
def camera_angles(spark: SparkSession, sf: str) -> DataFrame:
    f = A.signals(spark, sf).selectExpr("video_key", "frame div 4 AS shot_id", "cast(frame % 4 AS int) AS k", "vec")
    shots = f.select("video_key", "shot_id").distinct().selectExpr(
        "video_key", "shot_id", "shot_id * 7 % 13 * 1.5D AS duration", "if(shot_id % 3 > 0, 'main', 'other') AS kind"
    )
    out = media.reference_signature(f, shots, 0.2)
    return out.withColumn("corr", F.bround("corr", 5))


def _line_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 500 AS video_key", "l_quantity * 10 AS x1", "l_partkey % 500 * 1D AS y1", "l_quantity * 10 + l_suppkey % 90 + 1 AS x2", "l_partkey % 500 + l_suppkey % 4 * 1D AS y2"
    )


@query
def net_widths(spark: SparkSession, sf: str) -> DataFrame:
    return media.line_width(_line_pieces(spark, sf))


@query
def row_extents(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _line_pieces(spark, sf)
    return court.row_extents(pieces, pieces.select("video_key").distinct().selectExpr("video_key", "245D + video_key % 10 AS row"))


@query
def sound_onsets(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").selectExpr("user_id AS key", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i", "event_id * 1000 + value AS env")
    return media.onset_strength(e).withColumn("v", F.bround("v", 4))


@query
def player_readings(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").selectExpr(
        "cast(substring(source, 4) AS int) AS video_key", "doc_id AS shot_id", "if(doc_id % 9 = 0, 'null', concat(' ', lang, if(doc_id % 2 = 0, 'é ', '')))  AS name",
        "if(doc_id % 5 = 0, 'beige', ' Rouge') AS colour",
    )
    return media.player_readings(a, 10)


@query
def team_order(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "orders").selectExpr("o_custkey AS match", "cast(o_orderkey % 2 AS int) AS team", "cast(o_orderkey div 3 % 2 AS int) AS near")
    return media.order_teams(v)


@query
def reading_sequence(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").selectExpr("o_custkey AS match", "o_orderkey AS rally", "o_orderstatus AS before", "o_orderpriority AS after")
    return media.before_after(r)


@query
def annotation_items(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "lineitem").selectExpr(
        "concat_ws(':', l_orderkey, l_partkey, l_linenumber) AS key", "l_linenumber AS t", "l_returnflag AS side", "l_linestatus AS height", "concat('s', l_suppkey % 4) AS stroke"
    )
    return media.annotation_items(h)


@query
def rally_lines(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "lineitem").selectExpr("l_orderkey AS shot_id", "concat('p', l_linenumber % 4) AS player", "concat('s', l_suppkey % 4) AS stroke", "l_partkey * 10000000 + l_suppkey * 100 + l_linenumber AS t")
    return media.rally_lines(h)


@query
def stroke_table(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "lineitem").selectExpr("l_linenumber % 4 AS player", "concat('s', l_suppkey % 4) AS stroke")
    return media.stroke_table(h, ["s0", "s1", "s2"])


def _stream_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("user_id AS video_key", "cast(ts AS timestamp) AS ts", "event_type AS text")


@query
def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = tumbling.segment_counts(_stream_events(spark, sf), "1 hour")
    return out.select("video_key", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n", "texts")


@query
def rally_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = tumbling.rally_sessions(_stream_events(spark, sf), "6 hours")
    return out.select("video_key", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


@query
def wrist_speeds(spark: SparkSession, sf: str) -> DataFrame:
    poses = A.wrist_poses(spark, sf).withColumn("frame", F.col("frame") + 1)
    out = motion.wrist_speed(poses)
    return out.select("shot_id", "slot", "frame", F.bround("speed", 6).alias("speed"), F.bround("ratio", 5).alias("ratio"), "arm")


@query
def track_smooth(spark: SparkSession, sf: str) -> DataFrame:
    out = motion.smooth_tracks(A.tracks(spark, sf), 3)
    return out.select("shot_id", "slot", "frame", F.bround("x", 6).alias("x"), F.bround("y", 6).alias("y"))


@query
def player_tracks(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 750 AS shot_id", "l_partkey % 200 AS frame", "l_discount * 100 AS x", "l_quantity * 0.4D AS y", "l_extendedprice AS conf"
    )
    return motion.track_players(found, 30.0)


@query
def classifier_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = learning.folds(A.labelled(spark, sf), 5).where("truth IN ('c0', 'c1', 'c2')")
    values = F.array(*[F.crc32(F.concat_ws(":", "key", F.lit(i))) % 100 / 100 + F.when(F.col("truth") == "c1", 0.3).otherwise(0.0) for i in range(8)])
    samples = rows.select("key", "truth", "fold", values.alias("features"))
    return learning.cross_validate(samples, MERGED_CLASSES)


@query
def hit_measures(spark: SparkSession, sf: str) -> DataFrame:
    out = hits.typed_hits(A.hits(spark, sf), A.poses(spark, sf), A.shots(spark, sf).withColumn("start", F.lit(0.0)))
    return out.select("shot_id", "slot", "frame", "height", "overhead", "forehand", "wrist_low", "stroke", "confidence")


@query
def hit_features(spark: SparkSession, sf: str) -> DataFrame:
    h = hits.pose_measures(A.hits(spark, sf), A.poses(spark, sf))
    out = hits.hit_features(h, A.poses(spark, sf))
    return out.select("key", *[F.col("features")[i].cast("double").alias(f"f{i}") for i in range(hits.N_FEATURES)])


@query
def sound_peaks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").selectExpr("user_id AS key", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i", "value * if(event_id % 9 = 0, 40, 1) AS env")
    out = hits.onsets(media.onset_strength(e))
    return out.select("shot_id", F.bround("t", 4).alias("t"), F.bround(F.least("v", F.lit(1e6)), 4).alias("v"))


@query
def hits_detected(spark: SparkSession, sf: str) -> DataFrame:
    # Candidates, strongest slots and hits read the speeds.
    speeds = written(motion.wrist_speed(A.wrist_poses(spark, sf)), "wrist-speeds")
    shots = A.shots(spark, sf)
    sounds = table(spark, sf, "orders").where("o_orderkey div 400 % 3 > 0").selectExpr("o_orderkey div 400 AS shot_id", "(o_orderkey % 400) / 40D AS t")
    return hits.detect_hits(sounds, speeds, A.tracks(spark, sf), shots, 30.0)


@query
def net_base_rows(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _line_pieces(spark, sf)
    sides = pieces.select("video_key").distinct().selectExpr(
        "video_key", "50D AS top", "450D AS near", "100D AS lx1", "0D AS ly1", "0D AS lx2", "500D AS ly2", "400D AS rx1", "0D AS ry1", "500D AS rx2", "500D AS ry2"
    )
    return court.net_base_rows(pieces, sides).join(court.vanishing_rows(sides), "video_key")


@query
def court_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").selectExpr("p_partkey", "700D + p_size AS near", "400D + p_partkey % 50 AS net", "100D + p_size * 2 AS vanishing", "p_partkey % 20 * 1D AS depth")
    row = court.row_of(F.col("depth"), F.col("near"), F.col("net"), F.col("vanishing"))
    return p.select("p_partkey", F.bround(row, 5).alias("row"))


@query
def court_methods(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "orders").selectExpr(
        "o_custkey AS video_key", "element_at(array('net', 'sidelines_low', 'net', 'sidelines'), cast(o_orderkey % 4 AS int) + 1) AS method", "o_orderkey % 97 + o_orderkey / 1e6D AS residual_px"
    )
    return court.best_method(found)


@query
def centre_lines(spark: SparkSession, sf: str) -> DataFrame:
    pieces = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey div 500 AS video_key", "l_quantity * 10 AS x1", "l_partkey % 500 * 1D AS y1", "l_quantity * 10 + l_suppkey % 9 AS x2", "l_suppkey * 7 % 500 * 1D AS y2"
    )
    return court.centre_lines(pieces)


@query
def document_markdown(spark: SparkSession, sf: str) -> DataFrame:
    full = timeline.heard_and_context(A.utterances(spark, sf), _segments(spark, sf), A.SEGMENT_S).withColumn("seen", F.expr("if(seg_id % 7 = 0, context, NULL)"))
    videos = _event_videos(spark, sf).selectExpr(
        "video_key", "concat('v', video_key) AS name", "duration", "0.5D AS fps", "5D AS segment", "cast(NULL AS string) AS language", "if(video_key % 2 = 0, 'All of it.', NULL) AS summary"
    )
    frames = timeline.assign_frames(timeline.frame_grid(videos, 0.1), full, A.SEGMENT_S)
    return report.to_markdown(report.build_document(videos, full, frames, A.utterances(spark, sf), A.speech(spark, sf), {"vlm": "m"}))


def _strokes(spark: SparkSession, sf: str) -> DataFrame:
    """``video_key, player, stroke, n`` by the rules of pose."""
    h = decode.stroke_by_pose(_hits(spark, sf)).selectExpr("hit_id div 400 AS video_key", "concat('p', n) AS player", "stroke")
    return h.groupBy("video_key", "player", "stroke").agg(F.count("*").alias("n"))


@query
def report_strokes(spark: SparkSession, sf: str) -> DataFrame:
    return report.stroke_lines(_strokes(spark, sf))


@query
def report_players(spark: SparkSession, sf: str) -> DataFrame:
    stats_ = table(spark, sf, "lineitem").selectExpr("l_orderkey div 400 AS video_key", "concat('p', l_linenumber) AS player", "l_quantity", "l_tax").groupBy("video_key", "player").agg(
        F.sum("l_quantity").alias("distance_m"), (F.max("l_quantity") / 8).alias("speed_m_s"), (F.count("*") % 7 / 16).alias("net_share"), (F.count("*") % 5 / 16).alias("transition_share"), (F.count("*") % 3 / 16).alias("back_share")
    )
    return report.player_lines(stats_, _strokes(spark, sf).where("n > 3"))


@query
def report_teams(spark: SparkSession, sf: str) -> DataFrame:
    rallies = table(spark, sf, "orders").selectExpr("o_custkey AS video_key", "element_at(array('A', 'B', NULL), cast(o_orderkey % 3 AS int) + 1) AS winner")
    teams = table(spark, sf, "customer").selectExpr("c_custkey AS video_key", "inline(array(named_struct('pos', 0, 'team', 'A', 'colour', 'rouge'), named_struct('pos', 1, 'team', 'B', 'colour', NULL)))")
    return report.team_lines(rallies, teams).select("video_key", F.array_join("lines", "\n").alias("text"))


@query
def stroke_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return report.common_strokes(_strokes(spark, sf).groupBy("player", "stroke").agg(F.sum("n").alias("n")))


@query
def confusion_lines(spark: SparkSession, sf: str) -> DataFrame:
    return report.confusion_table(learning.confusion(A.labelled(spark, sf), MERGED_CLASSES), MERGED_CLASSES)


@query
def accuracy_lines(spark: SparkSession, sf: str) -> DataFrame:
    return report.accuracy_lines(learning.accuracy(A.labelled(spark, sf).withColumn("none", F.lit(None).cast("string")), "pred", "vlm", "none"))


@query
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.label_counters(A.labelled(spark, sf), "truth", "pred", "vlm")


@query
def label_standard(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.labelled(spark, sf).withColumns({"a": F.col("key") % 17 / 17, "b": F.col("key") * 1.0})
    return learning.standardized(rows, ["a", "b"]).select("key", F.bround("a", 6).alias("a"), F.bround("b", 6).alias("b"))


@query
def label_imports(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    saved = d.where("doc_id % 3 <> 0").selectExpr("source AS video", "cast(doc_id AS string) AS key", "lang AS label", "'model' AS annotator")
    fresh = d.where("doc_id % 4 = 0").selectExpr("source AS video", "cast(doc_id AS string) AS key", "if(doc_id % 8 = 0, 'en', 'xx') AS label")
    return stores.import_labels(saved, fresh, d.selectExpr("lang AS label"))


@query
def labels_certain(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").selectExpr("source AS video", "doc_id AS key", "n_chars")
    lab = A.labelled(spark, sf).selectExpr("video", "key", "if(key % 5 = 0, 'incertain', truth) AS label")
    return learning.labelled_hits(d, lab)


@query
def pose_rates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.bround(S.pose_fps(F.col("value") / 8), 6).alias("fps"), S.short_team(F.concat("event_type", F.lit("/x"))).alias("team"))


def queries() -> dict[str, Query]:
    """All queries; a cheap one first, as whoever compares them with SQL may still be starting up."""
    return {"label_counts": QUERIES["label_counts"], **QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.ORACLES.items() if k in QUERIES}
