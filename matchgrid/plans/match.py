"""The two analyses as a whole: matches from sounds and poses to their reports, and videos from speech and pictures to their documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.scalars import clean_answer, clock, first_json, one_of, player_name, report_key, short_team
from matchgrid.operators import decode, hits, learning, media, motion, report, score, stats, timeline
from matchgrid.operators.hits import ANKLES, NOSE, WRISTS
from matchgrid.session import dealt, work_folder, written
from matchgrid.sources.answers import asked_once


def wrist_columns(poses: DataFrame) -> DataFrame:
    """Wrists, their sureness and the body's height (nose to the ankles' middle) of ``shot_id, slot, frame, kpts``."""
    p = lambda k, c: F.get("kpts", F.lit(k))[c]
    foot = lambda c: (p(ANKLES[0], c) + p(ANKLES[1], c)) / 2
    wrists = [p(k, c).alias(f"{s}{c}") for s, k in zip("lr", WRISTS, strict=True) for c in "xyc"]
    return poses.select("shot_id", "slot", "frame", *wrists, F.hypot(p(NOSE, "x") - foot("x"), p(NOSE, "y") - foot("y")).alias("height"))


def find_hits(sounds: DataFrame, poses: DataFrame, tracks: DataFrame, shots: DataFrame, fps: float) -> DataFrame:
    """Typed hits from sounds (``shot_id, rate, samples``), poses and tracks of the rallies."""
    loud = hits.envelopes(sounds).withColumnRenamed("shot_id", "key")
    found = hits.onsets(media.onset_strength(loud))
    # The speeds are read for the candidates, the strongest slots and the hits.
    speeds = written(motion.wrist_speed(wrist_columns(poses)), "wrist-speeds")
    return hits.typed_hits(hits.detect_hits(found, speeds, tracks, shots, fps), poses, shots)


def checked_hits(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Hits after a vision model's answers ``shot_id, frame, slot, swing, answer``; those it rejects go."""
    both = found.join(answers, ["shot_id", "frame", "slot"], "left").withColumn("dist", F.col("dist_net"))
    return decode.refine_with_answers(both).drop("dist", "swing", "answer")


def current_hits(stored: DataFrame, poses: DataFrame, shots: DataFrame) -> DataFrame:
    """Stored hits with the pose rules of today: measured anew, with a model's label where it still fits.

    stored: hits as ``stores.load_hits`` gives them; ``stroke_model`` says that a model answered, whose label ``stroke``
    and ``confidence`` then are.
    """
    measured = ["stroke_pose", "height", "overhead", "forehand", "wrist_low"]
    before = stored.drop(*measured).withColumnsRenamed({"stroke": "stroke_before", "confidence": "confidence_before"})
    if "stroke_model" not in before.columns:
        before = before.withColumn("stroke_model", F.lit(None).cast("string"))
    h = hits.typed_hits(before, poses, shots)
    fits = F.col("stroke_model").isNotNull() & F.coalesce(F.array_contains(decode.allowed_strokes("height", "dist_net"), F.col("stroke_before")), F.lit(False))
    new = {c: F.when(fits, F.col(f"{c}_before")).otherwise(F.col(c)) for c in ("stroke", "confidence")}
    return h.withColumns(new).drop("stroke_before", "confidence_before")


def classified_hits(found: DataFrame, poses: DataFrame, model: dict, classes: list[str], trusted: bool) -> DataFrame:
    """Hits after the classifier: ``stroke_clf, clf_prob``, and its label where it is trusted."""
    named = found.withColumn("key", hits.hit_key())
    scored = learning.score_with_model(hits.hit_features(found, poses), model, classes)
    both = named.join(scored, "key", "left")
    if "stroke_model" not in both.columns:
        both = both.withColumn("stroke_model", F.lit(None).cast("string"))
    out = decode.apply_classifier(both, trusted) if trusted else both
    return out.withColumnsRenamed({"label": "stroke_clf", "prob": "clf_prob"})


def team_sides(sides: DataFrame, centres: DataFrame, shirts: DataFrame) -> DataFrame:
    """``shot_id, side, team`` from the mean colours of the sides (``match, shot_id, side, r, g, b``).

    centres: the two colour centres of each match; shirts: ``match, pos, team``, the team of either
    centre. The far side has the first team if that gives the smaller sum of
    distances; so it does where a colour is missing.
    """
    dist = lambda c: F.sqrt(sum((F.col(x) - F.col(f"{c}.{x}")) ** 2 for x in "rgb"))
    d = sides.join(centres, "match").select("match", "shot_id", "side", dist("c0").alias("d0"), dist("c1").alias("d1"))
    cost = lambda far, near: F.sum(F.when(F.col("side") == "far", F.col(far)).otherwise(F.col(near)))
    known = F.count("d0") == 2
    order = d.groupBy("match", "shot_id").agg(F.coalesce(known & (cost("d0", "d1") > cost("d1", "d0")), F.lit(False)).alias("swapped"))
    both = F.explode(F.array(F.struct(F.lit("far").alias("side"), F.lit(0).alias("i")), F.struct(F.lit("near").alias("side"), F.lit(1).alias("i"))))
    placed = order.select("match", "shot_id", both.alias("p"), "swapped").select("match", "shot_id", "p.side", F.when(F.col("swapped"), 1 - F.col("p.i")).otherwise(F.col("p.i")).alias("pos"))
    return placed.join(shirts, ["match", "pos"]).select("shot_id", "side", "team")


def shirt_order(teams: DataFrame, readings: DataFrame, centres: DataFrame) -> DataFrame:
    """The teams ``match, pos, team`` in the order of their match's colour centres, as most readings of shirts say.

    readings: ``match, obs_id, name, colour``. A reading speaks for the team whose player it names, and for the
    centre its colour's RGB is nearer to; without a majority the order stays.
    """
    votes = stats.team_votes(teams, readings, ("match",))
    # The palette is a fixed list of colours.
    palette = readings.sparkSession.createDataFrame([(w, *map(float, rgb)) for w, *rgb in stats.PALETTE], "colour string, r double, g double, b double")
    dist = lambda c: sum((F.col(x) - F.col(f"{c}.{x}")) ** 2 for x in "rgb")
    seen = votes.join(F.broadcast(palette), "colour").join(centres, "match").join(teams, ["match", "team"])
    cast = seen.select("match", F.col("pos").alias("team"), (dist("c0") > dist("c1")).cast("int").alias("near"), F.explode(F.expr("sequence(1, cast(votes AS int))")))
    order = media.order_teams(cast).select("match", "swapped")
    pos = F.when(F.coalesce("swapped", F.lit(False)), 1 - F.col("pos")).otherwise(F.col("pos"))
    return teams.join(order, "match", "left").select("match", pos.alias("pos"), "team")


def named_players(tracks: DataFrame, sides: DataFrame) -> DataFrame:
    """``shot_id, slot, side, team, player``: each slot by its team and its side of the court."""
    roles = stats.slot_roles(tracks).withColumn("side", F.when(F.col("slot") < 2, "far").otherwise("near"))
    return roles.join(sides, ["shot_id", "side"]).select("shot_id", "slot", "side", "team", player_name("team", "role").alias("player"))


def named_hits(found: DataFrame, players: DataFrame) -> DataFrame:
    """Hits with their player and the short name of the team."""
    return found.join(players.select("shot_id", "slot", "team", "player"), ["shot_id", "slot"]).withColumn("team_short", short_team("team")).drop("team")


def score_text(state: Column) -> Column:
    """One state as text: games and points of ``team_a`` and ``team_b``; empty where it was not read."""
    side = lambda team, i: F.concat(F.col(team), F.lit(" "), F.array_join(state["games"][i].cast("array<string>"), " "), F.lit(" ["), state["points"][i], F.lit("]"))
    return F.when(state.isNotNull(), F.concat_ws(" · ", side("team_a", 0), side("team_b", 1))).otherwise("")


def team_pairs(teams: DataFrame) -> DataFrame:
    """``match, team_a, team_b`` of teams ``match, pos, team``."""
    one = lambda k, name: F.max(F.when(F.col("pos") == k, F.col("team"))).alias(name)
    return teams.groupBy("match").agg(one(0, "team_a"), one(1, "team_b"))


def rally_table(rallies: DataFrame, states: DataFrame, hits_: DataFrame, teams: DataFrame) -> DataFrame:
    """``match, video_key, shot_id, start, before, after, winner, n_hits`` of every rally.

    states: ``match, shot_id, part`` (0 before, 1 after), ``games, points``, as read; they are one sequence
    in order of rally and part, of which only rows that fit their neighbours count.
    """
    order = F.row_number().over(Window.partitionBy("match").orderBy("shot_id", "part")) - 1
    kept = score.clean_sequence(states.withColumn("ord", order.cast("int"))).withColumn("s", F.when(F.col("kept"), F.struct("games", "points")))
    wide = kept.groupBy("match", "shot_id").agg(F.first(F.when(F.col("part") == 0, F.col("s")), True).alias("s"), F.first(F.when(F.col("part") == 1, F.col("s")), True).alias("e"))
    nxt = F.lead("s").over(Window.partitionBy("match").orderBy("shot_id"))
    wide = wide.withColumn("n", nxt).join(team_pairs(teams), "match")
    won = F.coalesce(score.point_winner("s", "e"), score.point_winner("s", "n"))
    winner = F.when(won == 0, F.col("team_a")).when(won == 1, F.col("team_b"))
    points = wide.select("match", "shot_id", score_text(F.col("s")).alias("before"), score_text(F.col("e")).alias("after"), winner.alias("winner"))
    n = hits_.groupBy("shot_id").agg(F.count("*").alias("n_hits"))
    out = rallies.join(points, ["match", "shot_id"], "left").join(n, "shot_id", "left")
    return out.select("match", "video_key", "shot_id", "start", "before", "after", "winner", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def analyse(
    shots: DataFrame, sounds: DataFrame, poses: DataFrame, tracks: DataFrame, colours: DataFrame, states: DataFrame, teams: DataFrame, fps: float = 30.0,
    answers: DataFrame | None = None, model: tuple[dict, list[str], bool] | None = None, readings: DataFrame | None = None, max_gap: int = 15,
) -> dict[str, DataFrame]:
    """Any number of matches as tables: ``hits, players, stats, strokes, rallies, report``.

    shots: ``match, video_key, shot_id, start, end, kind, replay`` (without ``match`` each video is one);
    colours: ``shot_id, slot, r, g, b`` samples; teams: ``match, pos, team``, 0 and 1 as on the scoreboard; model: a
    fitted classifier, its classes and whether it is trusted; readings: ``match, obs_id, name, colour``, names and colours
    read from shirts, without which the first team has the darker ones. Shot ids are unique over all
    videos. A match without teams has no players; its sounds are analysed all the same.
    """
    if "match" not in shots.columns:
        shots = shots.withColumn("match", F.col("video_key"))
    rallies = shots.where(stats.is_rally())
    own = rallies.select("shot_id")
    poses, tracks = poses.join(own, "shot_id", "left_semi"), tracks.join(own, "shot_id", "left_semi")
    found = find_hits(sounds.join(own, "shot_id", "left_semi"), poses, tracks, rallies, fps)
    if answers is not None:
        found = checked_hits(found, answers)
    if model is not None:
        found = classified_hits(found, poses, *model)
    video = rallies.select("shot_id", "match", "video_key")
    sides = media.side_colours(media.slot_colours(colours.join(own, "shot_id", "left_semi"))).join(video.select("shot_id", "match"), "shot_id")
    # Centres, hits and players feed several tables: each is worked out once.
    sides = written(sides, "sides")
    centres = written(stats.two_means(sides), "centres")
    shirts = teams if readings is None else shirt_order(teams, readings, centres)
    players = written(named_players(tracks, team_sides(sides, centres, shirts)), "players", instead_of=(sides, centres))
    named = written(named_hits(found, players).join(video, "shot_id"), "hits")
    pieces = motion.smooth_tracks(tracks, max_gap).join(players.select("shot_id", "slot", "player"), ["shot_id", "slot"]).join(video, "shot_id")
    per_player = written(stats.player_stats(pieces, fps, ("match", "player")), "player-stats")
    strokes = named.groupBy("match", "player", report_key("stroke").alias("stroke")).agg(F.count("*").alias("n"))
    points = rally_table(rallies, states, named, teams)
    seconds = rallies.groupBy("match").agg(F.count("*").alias("n_rallies"), F.sum(F.col("end") - F.col("start")).alias("rally_seconds"))
    last = score.last_score(states.withColumn("ord", F.col("shot_id") * 2 + F.col("part")), team_pairs(teams)).select("match", F.col("line").alias("score"), "story")
    meta = shots.groupBy("match").agg(F.count("*").alias("n_shots"), F.max("end").alias("duration")).join(seconds, "match").join(last, "match", "left")
    meta = meta.withColumns({"title": F.col("match").cast("string"), "summary": F.lit(None).cast("string")})
    line = F.concat(F.lit("- "), clock("start"), F.lit(" "), F.coalesce(F.nullif("before", F.lit("")), F.lit("score not read")), F.lit(", "), F.col("n_hits").cast("string"), F.lit(" hits"), F.coalesce(F.concat(F.lit(", point for "), "winner"), F.lit("")))
    names = meta.select("match").join(teams, "match").withColumn("colour", F.lit(None).cast("string"))
    by_match = lambda df: df.drop("video_key").withColumnRenamed("match", "video_key")
    text = report.match_report(*map(by_match, (meta, points, names, per_player, strokes, points.select("match", "start", line.alias("line")))))
    text = text.withColumnRenamed("video_key", "match")
    return {"hits": named, "players": players, "stats": per_player, "strokes": strokes, "rallies": points, "report": text}


#: Kinds of shots that a model may answer with.
SHOT_KINDS = ("main", "other_angle", "close_up", "crowd", "graphic", "other")


def shots_by_answers(shots: DataFrame, make_client: Callable[[], Callable[[str], str]], store: str, model: str = "") -> DataFrame:
    """Shots with ``kind, replay, scoreboard`` as a model answers for their key frames; each shot is asked for once.

    shots: ``video_key, shot_id`` and ``keyframes``, names of pictures. An answer that is no JSON, or of no known kind,
    makes the shot ``other``, live and without scoreboard.
    """
    key = F.to_json(F.struct("video_key", "shot_id"))
    ask = F.concat(
        F.lit("Pictures of the begin, middle and end of one shot: "), F.array_join("keyframes", ", "), F.lit(f". Its type is one of {', '.join(SHOT_KINDS)}. Answer with one JSON object: "),
        F.lit('{"type": type, "replay": whether it is a replay or slow motion, "scoreboard": whether a scoreboard is shown}'),
    )
    keyed = written(shots.withColumn("key", key), "shots")
    told = asked_once(keyed.select("key", ask.alias("prompt")), store, make_client, model).withColumn("a", first_json(clean_answer("answer"), "type string, replay boolean, scoreboard boolean"))
    told = told.select("key", one_of("a.type", SHOT_KINDS, "other").alias("kind"), *[F.coalesce(f"a.{c}", F.lit(False)).alias(c) for c in ("replay", "scoreboard")])
    return keyed.join(told, "key").drop("key")


#: Segments that a summary is asked for at once.
CHUNK = 40


def summaries(segments: DataFrame, ask: Callable[[DataFrame], DataFrame], size: int = CHUNK) -> DataFrame:
    """``video_key, summary``: of a video of more than ``size`` segments, chunks of so many are summarized first.

    segments: ``video_key, seg_id, start, end, seen, heard``; ``ask`` answers prompts ``key, prompt``. The chunks of
    all videos are asked for together, then the videos.
    """
    place = Window.partitionBy("video_key").orderBy("seg_id")
    numbered = dealt(segments, "video_key").withColumn("chunk", F.floor((F.row_number().over(place) - 1) / size).cast("int"))
    texts = written(timeline.timeline_text(numbered, ("video_key", "chunk"), spans=True), "chunks")
    long = texts.groupBy("video_key").agg(F.count("*").alias("n")).where("n > 1").select("video_key")
    parts = texts.join(long, "video_key", "left_semi")
    key = F.to_json(F.struct("video_key", "chunk"))
    asked = parts.select("video_key", "chunk", "start", "end", key.alias("key"), F.concat(F.lit("Summarize this part ("), clock("start"), F.lit("–"), clock("end"), F.lit("):\n"), "text").alias("prompt"))
    told = asked.join(ask(asked.select("key", "prompt")).select("key", "answer"), "key")
    line = F.concat(F.lit("["), clock("start"), F.lit("–"), clock("end"), F.lit("] "), F.coalesce("answer", F.lit("")))
    joined = told.select("video_key", "chunk", line.alias("line")).groupBy("video_key").agg(F.array_sort(F.collect_list(F.struct("chunk", "line"))).alias("l"))
    joined = joined.select("video_key", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))
    whole = texts.join(long, "video_key", "left_anti").select("video_key", "text").unionByName(joined)
    prompts = whole.select("video_key", F.to_json(F.struct("video_key")).alias("key"), F.concat(F.lit("Summarize this timeline:\n"), "text").alias("prompt"))
    return prompts.join(ask(prompts.select("key", "prompt")).select("key", "answer"), "key").select("video_key", F.col("answer").alias("summary"))


def describe(
    videos: DataFrame, utterances: DataFrame, speech: DataFrame, make_client: Callable[[], Callable[[str], str]], models: dict[str, str], fps: float = 1.0, size: float = 5.0,
    store: str | None = None, chunk: int = CHUNK,
) -> dict[str, DataFrame]:
    """Videos as tables: ``segments`` with what was seen and heard, ``summaries``, ``documents`` and ``markdown``.

    videos: ``video_key, name, duration`` and any facts of a probe report; utterances as they were
    recognized, of which those with a word in detected speech count. Each segment that has a frame is asked
    for once, with what is heard around it, and a summary of each video, of a long one by chunks.
    Answers are written before anything is made of them, to ``store`` if that is given: what
    is found there is not asked for again.
    """
    spark = videos.sparkSession
    folder = store or f"{work_folder(spark)}/answers-{uuid.uuid4().hex}"
    ask = lambda prompts: asked_once(prompts, folder, make_client, models.get("vlm", ""))
    kept = timeline.filter_utterances(utterances, speech, videos)
    # All that follows by segment stays in these partitions.
    segs = dealt(timeline.plan_segments(videos, size), "video_key", "seg_id")
    grid = timeline.framed_segments(videos, fps, size)
    held = grid.groupBy("video_key", "seg_id").agg(F.count("*").alias("n_frames"))
    heard = timeline.heard_and_context(kept, segs, size).join(held, ["video_key", "seg_id"])
    key = F.to_json(F.struct("video_key", "seg_id"))
    around = F.when(F.col("context") != "", F.concat(F.lit("Heard at the same time: "), "context", F.lit("\n"))).otherwise("")
    prompt = F.concat(F.lit("Describe what is seen in "), F.col("n_frames").cast("string"), F.lit(" frames of "), clock("start"), F.lit("–"), clock("end"), F.lit(".\n"), around)
    full = written(heard.withColumn("key", key).withColumn("prompt", prompt), "segments")
    seen = ask(full.select("key", "prompt")).select("key", F.trim("answer").alias("seen"))
    full = written(full.join(seen, "key", "left").drop("key", "prompt", "n_frames"), "seen", instead_of=(full,))
    told = videos.join(written(summaries(full, ask, chunk), "summaries"), "video_key", "left")
    told = told.withColumns({"fps": F.lit(fps), "segment": F.lit(size), "language": F.lit(None).cast("string")})
    docs = report.build_document(told, full, grid, kept, speech, models)
    return {"segments": full, "summaries": told.select("video_key", "summary"), "documents": docs, "markdown": report.to_markdown(docs)}
