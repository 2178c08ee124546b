"""Timeline: segments, what was seen and heard in each, and its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions.scalars import clock, even_fit, has_word

MIN_OVERLAP_S = 0.2


def _in_order(key: str, text: str) -> Column:
    """Texts joined in the order of a key."""
    pairs = F.array_sort(F.collect_list(F.struct(key, text)))
    return F.array_join(F.transform(pairs, lambda p: p[text]), " ")


def plan_segments(videos: DataFrame, size: float) -> DataFrame:
    """``video_key, seg_id, start, end``: windows of ``size`` seconds, the last cut short."""
    n = F.ceil((F.col("duration") - 1e-6) / size).cast("int")
    cut = videos.where((F.col("duration") > 0) & F.lit(size > 0)).select(
        "video_key", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("seg_id")
    )
    start = F.bround(F.col("seg_id") * size, 3)
    return cut.select("video_key", "seg_id", start.alias("start"), F.bround(F.least(start + size, "duration"), 3).alias("end"))


def frame_grid(videos: DataFrame, fps: float) -> DataFrame:
    """``video_key, frame, t``: one frame every 1/fps seconds, one at least."""
    n = F.greatest(F.lit(1), F.floor(F.col("duration") * fps + 0.5).cast("int"))
    grid = videos.select("video_key", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame"))
    return grid.withColumn("t", F.bround(F.col("frame") / fps, 3))


def assign_frames(frames: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """Each frame with the segment it falls in; what lies behind goes to the last.

    The segment number follows from the time, so this is an equi-join with one
    row per video, not a range join. Exploded rows look as small as the
    videos they come from, so the planner is told not to broadcast them.
    """
    count = segments.groupBy("video_key").agg(F.count("*").alias("n")).hint("merge")
    seg = F.least(F.floor(F.col("t") / size), F.col("n") - 1).cast("int")
    return frames.join(count, "video_key").select("video_key", "frame", "t", seg.alias("seg_id"))


def framed_segments(videos: DataFrame, fps: float, size: float) -> DataFrame:
    """``video_key, frame, t, seg_id``: the grid of frames with their segments, as ``assign_frames`` gives them.

    A video's length says how many segments it has, so no frame is moved for that.
    """
    n = F.ceil((F.col("duration") - 1e-6) / size).cast("int")
    long = videos.where((F.col("duration") > 0) & F.lit(size > 0)).select("video_key", "duration", n.alias("n"))
    n_frames = F.greatest(F.lit(1), F.floor(F.col("duration") * fps + 0.5).cast("int"))
    grid = long.select("video_key", "n", F.explode(F.sequence(F.lit(0), n_frames - 1)).alias("frame"))
    grid = grid.withColumn("t", F.bround(F.col("frame") / fps, 3))
    return grid.select("video_key", "frame", "t", F.least(F.floor(F.col("t") / size), F.col("n") - 1).cast("int").alias("seg_id"))


def heard_and_context(utterances: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """Segments with ``heard`` (by midpoint, each utterance once) and ``context``
    (every utterance that overlaps); a midpoint outside all segments counts for
    the last. Both are equi-joins on the segment number."""
    last = segments.groupBy("video_key").agg(F.max("seg_id").alias("last_id"), F.max("end").alias("until"))
    u = utterances.join(last, "video_key")
    mid = (F.col("start") + F.col("end")) / 2
    own = F.when((mid >= 0) & (mid < F.col("until")), F.floor(mid / size)).otherwise(F.col("last_id")).cast("int")
    heard = u.groupBy("video_key", own.alias("seg_id")).agg(_in_order("utt_id", "text").alias("heard"))
    low = F.greatest(F.lit(0), F.floor(F.col("start") / size)).cast("int")
    high = F.least("last_id", F.floor(F.col("end") / size)).cast("int")
    near = u.where(low <= high).select(
        "video_key", "utt_id", "text", F.col("start").alias("b"), F.col("end").alias("e"),
        F.explode(F.sequence(low, high)).alias("seg_id"),
    )
    overlap = near.join(segments.hint("merge"), ["video_key", "seg_id"]).where("b < end AND e > start")
    context = overlap.groupBy("video_key", "seg_id").agg(_in_order("utt_id", "text").alias("context"))
    joined = segments.join(heard, ["video_key", "seg_id"], "left").join(context, ["video_key", "seg_id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("heard", "context")})


def filter_utterances(raw: DataFrame, speech: DataFrame, duration: float | DataFrame, bucket: float = 5.0) -> DataFrame:
    """Utterances with a word, cut to the video, that overlap detected speech enough.

    duration: that of every video, or a table ``video_key, duration``.

    The overlap join goes through time buckets, so it is an equi-join; a pair
    that shares several buckets counts in the first of them only.
    """
    timed = raw.join(duration.select("video_key", "duration"), "video_key") if isinstance(duration, DataFrame) else raw.withColumn("duration", F.lit(duration))
    u = timed.where(has_word("text")).select(
        "video_key", "utt_id", F.trim("text").alias("text"),
        F.greatest(F.lit(0.0), "start").alias("start"), F.least("duration", "end").alias("end"),
    ).where("end > start")

    def buckets(b: str, e: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(b) / bucket), F.floor(F.col(e) / bucket)))

    left = u.select("video_key", "utt_id", "start", "end", buckets("start", "end").alias("k"))
    right = speech.where("e > b").select("video_key", "b", "e", buckets("b", "e").alias("k"))
    pairs = left.join(right, ["video_key", "k"]).where(
        F.col("k") == F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("b") / bucket))
    )
    shared = F.greatest(F.lit(0.0), F.least("end", "e") - F.greatest("start", "b"))
    total = pairs.groupBy("video_key", "utt_id").agg(F.sum(shared).alias("overlap"))
    kept = u.join(total, ["video_key", "utt_id"], "left").where(
        F.coalesce("overlap", F.lit(0.0)) >= F.least(F.lit(MIN_OVERLAP_S), (F.col("end") - F.col("start")) / 2)
    )
    return kept.select("video_key", "utt_id", F.bround("start", 2).alias("start"), F.bround("end", 2).alias("end"), "text")


def talk_time(speech: DataFrame) -> DataFrame:
    """``video_key, seconds`` of detected speech ``video_key, b, e``."""
    return speech.groupBy("video_key").agg(F.bround(F.sum(F.col("e") - F.col("b")), 3).alias("seconds"))


def timeline_text(segments: DataFrame, by: tuple[str, ...] = ("video_key",), spans: bool = False) -> DataFrame:
    """One line per segment, joined in order, for a summary prompt; with ``spans`` also ``start`` and ``end``."""
    line = F.concat(
        F.lit("["), clock("start"), F.lit("–"), clock("end"), F.lit("] SEEN: "),
        F.coalesce(F.nullif("seen", F.lit("")), F.lit("—")),
        F.when(F.col("heard") != "", F.concat(F.lit(" | HEARD: "), "heard")).otherwise(""),
    )
    lines = segments.select(*by, "seg_id", "start", "end", line.alias("line"))
    pairs = F.array_sort(F.collect_list(F.struct("seg_id", "line")))
    text = F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("text")
    return lines.groupBy(*by).agg(text, *([F.min("start").alias("start"), F.max("end").alias("end")] if spans else []))


def summary_chunks(segments: DataFrame, size: int = 40) -> DataFrame:
    """Segments numbered into chunks of ``size`` for a two-level summary."""
    return segments.withColumn("chunk", F.floor(F.col("seg_id") / size).cast("int"))


def timeline_document(segments: DataFrame) -> DataFrame:
    """One nested document per video: its segments in order."""
    seg = F.struct("seg_id", "start", "end", "heard", "context")
    return segments.groupBy("video_key").agg(F.array_sort(F.collect_list(seg)).alias("segments"))


def model_plan(videos: DataFrame, fps: float, segment: float, size: int, weights_gb: float) -> DataFrame:
    """Frames, segments, prompt tokens and memory that a run would take."""
    w, h = F.col("width"), F.col("height")
    out = videos.select(
        "video_key",
        F.greatest(F.lit(1), F.floor(F.col("duration") * fps + 0.5)).cast("int").alias("n_frames"),
        F.greatest(F.lit(0), F.ceil((F.col("duration") - 1e-6) / segment)).cast("int").alias("n_segments"),
        even_fit(w, w, h, size).alias("frame_w"),
        even_fit(h, w, h, size).alias("frame_h"),
    )
    side = lambda c: F.greatest(F.lit(1), F.bround(F.col(c) / 32).cast("int"))
    out = out.withColumn("image_tokens", side("frame_h") * side("frame_w"))
    per = F.ceil(F.lit(segment * fps)).cast("int")
    out = out.withColumn("prompt_tokens", per * (F.col("image_tokens") + 2) + 150)
    return out.withColumn("peak_gb", F.lit(weights_gb) + 1.1 + F.col("prompt_tokens") * 0.22 / 1000)
