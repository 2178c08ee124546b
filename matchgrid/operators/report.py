"""Documents and reports: nested rows and Markdown texts, one for each video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrid.functions.scalars import clock, report_key

SCHEMA_VERSION = "1.0"
#: Strokes of a report in order, with the names it gives them.
REPORT_STROKES = {
    "service": "service", "coup_droit": "forehand", "revers": "backhand", "volee_cd": "forehand volley", "volee_revers": "backhand volley",
    "bandeja_vibora": "bandeja / víbora", "smash": "smash", "lob": "lob", "sortie_vitre": "off the glass",
}


def _ordered(key: str, *columns: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(key, *columns)))


def percent(c: str | Column) -> Column:
    """A share as whole percent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.format_string("%.0f", F.rint(c * 100)), F.lit(" %"))


#: The facts of a video, and of a run, that a document holds, with their kinds.
FACTS = {
    "path": "string", "name": "string", "key": "string", "duration": "double", "width": "int", "height": "int", "native_fps": "double",
    "has_audio": "boolean", "rotation": "int", "codec": "string", "pix_fmt": "string", "hdr": "boolean",
}
STATS = "struct<seconds: double, prompt_tokens: long, generation_tokens: long, peak_gb: double, finish_reason: string>"


def build_document(videos: DataFrame, segments: DataFrame, frames: DataFrame, utterances: DataFrame, speech: DataFrame, models: dict[str, str]) -> DataFrame:
    """One document of ten keys for each video: ``video_key`` and ``document``.

    videos: ``video_key, name, duration, fps, segment, language, summary``, any other of ``FACTS``, and ``timings``, a map
    of seconds by step; segments may have ``stats`` of their answer. What is not given is null, and timings are empty. The other
    tables carry the video's key. Lists are in order of their number or time.
    """
    by = "video_key"
    given = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    shown = frames.groupBy(by, "seg_id").agg(_ordered("frame", "t").alias("frames"))
    segs = segments.withColumn("stats", given(segments, "stats", STATS)).join(shown, [by, "seg_id"], "left")
    segs = segs.withColumn("frames", F.coalesce("frames", F.expr("array()").cast("array<struct<frame:int,t:double>>")))
    parts = [
        segs.groupBy(by).agg(_ordered("seg_id", "start", "end", "frames", "seen", "heard", "stats").alias("segments")),
        utterances.groupBy(by).agg(_ordered("utt_id", "start", "end", "text").alias("transcript")),
        speech.groupBy(by).agg(_ordered("b", "e").alias("speech")),
    ]
    out = videos
    for p in parts:
        out = out.join(p, by, "left")
    facts = [F.coalesce(given(videos, c, k), F.col(by).cast("string")).alias(c) if c == "key" else given(videos, c, k) for c, k in FACTS.items()]
    timings = F.coalesce(given(videos, "timings", "map<string,double>"), F.create_map().cast("map<string,double>")).alias("timings")
    doc = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(*facts).alias("video"), F.struct("fps", "segment").alias("config"),
        F.struct(*[F.lit(v).alias(k) for k, v in models.items()]).alias("models"), F.struct("language", "speech").alias("audio"),
        "transcript", "segments", "summary", timings, F.create_map().cast("map<string,string>").alias("extensions"),
    )
    return out.select(by, doc.alias("document"))


def document_json(documents: DataFrame) -> DataFrame:
    """The documents as JSON texts, with keys whose value is unknown."""
    return documents.select("video_key", F.to_json("document", {"ignoreNullFields": "false"}).alias("json"))


def to_markdown(documents: DataFrame) -> DataFrame:
    """``video_key, markdown``: title, facts, summary and the timeline of a document."""
    d = lambda c: F.col(f"document.{c}")
    number = lambda c: F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")

    def part(s: Column) -> Column:
        """Blocks of one segment."""
        block = lambda c, name: F.when(F.coalesce(s[c], F.lit("")) != "", F.array(F.concat(F.lit(f"**{name}:** "), s[c]), F.lit("")))
        none = F.expr("cast(array() AS array<string>)")
        head = F.array(F.concat(F.lit("### "), clock(s["start"]), F.lit(" – "), clock(s["end"])), F.lit(""))
        return F.concat(head, F.coalesce(block("seen", "Seen"), none), F.coalesce(block("heard", "Heard"), none))

    head = F.array(
        F.concat(F.lit("# Timeline of "), d("video.name")), F.lit(""),
        F.concat(F.lit("Length "), clock(d("video.duration")), F.lit("; model `"), d("models.vlm"), F.lit("`; "), number(d("config.fps")), F.lit(" frames a second in segments of "), number(d("config.segment")), F.lit(" s")),
        F.lit(""),
    )
    empty = F.expr("cast(array() AS array<string>)")
    summary = F.when(F.coalesce(d("summary"), F.lit("")) != "", F.array(F.lit("## Summary"), F.lit(""), d("summary"), F.lit(""))).otherwise(empty)
    timeline = F.concat(F.array(F.lit("## Segments"), F.lit("")), F.flatten(F.transform(F.coalesce(d("segments"), F.expr("array()").cast(documents.schema["document"].dataType["segments"].dataType)), part)))
    return documents.select("video_key", F.array_join(F.concat(head, summary, timeline), "\n").alias("markdown"))


def confusion_table(confusion: DataFrame, classes: list[str]) -> DataFrame:
    """Lines ``pos, line`` of a Markdown table from ``truth, pred, n`` of all pairs."""
    counts = confusion.groupBy("truth").pivot("pred", classes).agg(F.first("n"))
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("truth")).cast("int")
    line = F.concat(F.lit("| **"), F.col("truth"), F.lit("** | "), F.concat_ws(" | ", *[F.col(f"`{c}`").cast("string") for c in classes]), F.lit(" |"))
    head = [(-1, "| true, predicted | " + " | ".join(classes) + " |"), (0, "|---|" + "---|" * len(classes))]
    return confusion.sparkSession.createDataFrame(head, "pos int, line string").unionByName(counts.select(order.alias("pos"), line.alias("line")))


def accuracy_lines(accuracy: DataFrame) -> DataFrame:
    """``answer, line``: accuracies of ``answer, n, accuracy`` as table lines; a dash where nothing was answered."""
    value = F.when(F.col("n") > 0, F.concat(percent("accuracy"), F.lit(" (n="), F.col("n").cast("string"), F.lit(")"))).otherwise("—")
    return accuracy.select("answer", F.concat(F.lit("| "), "answer", F.lit(" | "), value, F.lit(" |")).alias("line"))


def label_counters(rows: DataFrame, *columns: str) -> DataFrame:
    """``counter, value, n``: rows of each value of the named columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.counter", "p.value").agg(F.count("*").alias("n"))


def common_strokes(strokes: DataFrame) -> DataFrame:
    """``player, line``: a player's strokes, the most frequent first, of equal ones by name."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "stroke")))
    text = F.array_join(F.transform(ordered, lambda s: F.concat(s["stroke"], F.lit(" "), (-s["m"]).cast("string"))), ", ")
    return strokes.groupBy("player").agg(text.alias("line"))


def team_lines(rallies: DataFrame, teams: DataFrame) -> DataFrame:
    """``video_key, lines``: teams in order with their shirt and the points that are known to be theirs.

    rallies: ``video_key, winner`` (team or null); teams: ``video_key, pos, team, colour``.
    """
    won = rallies.where("winner is not null").groupBy("video_key", F.col("winner").alias("team")).agg(F.count("*").alias("won"))
    unknown = rallies.groupBy("video_key").agg(F.count_if(F.col("winner").isNull()).alias("unknown"), F.count("*").alias("rallies"))
    t = teams.join(won, ["video_key", "team"], "left")
    line = F.concat(F.lit("- **"), "team", F.lit("**: shirt "), F.coalesce("colour", F.lit("?")), F.lit("; points known to be won: "), F.coalesce("won", F.lit(0)).cast("string"))
    lines = t.select("video_key", "pos", line.alias("line")).groupBy("video_key").agg(_ordered("pos", "line").alias("l")).join(unknown, "video_key", "left")
    last = F.concat(F.lit("No known winner in "), F.col("unknown").cast("string"), F.lit(" of the rallies, which are "), F.col("rallies").cast("string"))
    return lines.select("video_key", F.concat(F.transform("l", lambda x: x["line"]), F.when(F.col("rallies") > 0, F.array(F.lit(""), last)).otherwise(F.expr("cast(array() AS array<string>)"))).alias("lines"))


def player_lines(stats: DataFrame, strokes: DataFrame) -> DataFrame:
    """``video_key, player, line``: a player's row of the report.

    stats: ``video_key, player`` and the columns of ``player_stats``; strokes: ``video_key, player, stroke, n``.
    """
    n = strokes.groupBy("video_key", "player").agg(F.sum("n").alias("hits"))
    s = stats.join(n, ["video_key", "player"], "left")
    cells = [
        F.col("player"), F.coalesce("hits", F.lit(0)).cast("string"), F.concat(F.format_string("%.0f", F.rint("distance_m")), F.lit(" m")),
        F.concat(F.format_string("%.1f", F.bround("speed_m_s", 1)), F.lit(" m/s")), percent("net_share"), percent("transition_share"), percent("back_share"),
    ]
    return s.select("video_key", "player", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def stroke_lines(strokes: DataFrame) -> DataFrame:
    """``video_key, player, line``: a player's counts of each stroke of the report, zeros included."""
    cells = [F.coalesce(F.sum(F.when(report_key("stroke") == k, F.col("n"))), F.lit(0)).cast("string").alias(k) for k in REPORT_STROKES]
    wide = strokes.groupBy("video_key", "player").agg(*cells)
    return wide.select("video_key", "player", F.concat(F.lit("| "), F.concat_ws(" | ", "player", *REPORT_STROKES), F.lit(" |")).alias("line"))


def match_report(meta: DataFrame, rallies: DataFrame, teams: DataFrame, stats: DataFrame, strokes: DataFrame, points: DataFrame) -> DataFrame:
    """``video_key, markdown``: the report of each match.

    meta: ``video_key, title, duration, n_shots, n_rallies, rally_seconds, score, story, summary``;
    points: ``video_key, start, line`` (one line for each rally, in order of start).
    """
    by = "video_key"
    listed = lambda df, key: df.groupBy(by).agg(F.transform(_ordered(key, "line"), lambda x: x["line"]).alias("lines"))
    blocks = {"teams": team_lines(rallies, teams), "players": listed(player_lines(stats, strokes), "player"), "strokes": listed(stroke_lines(strokes), "player"), "points": listed(points, "start")}
    out = meta
    for name, df in blocks.items():
        out = out.join(df.select(by, F.col("lines").alias(name)), by, "left")
    none = F.expr("cast(array() AS array<string>)")
    text = lambda c, *before: F.when(F.coalesce(c, F.lit("")) != "", F.array(*[F.lit(b) for b in before], c, F.lit(""))).otherwise(none)
    table = lambda name, title, *head: F.concat(F.array(F.lit(title), F.lit(""), *[F.lit(h) for h in head]), F.coalesce(name, none), F.array(F.lit("")))
    facts = F.concat(
        F.lit("Length "), clock("duration"), F.lit("; "), F.col("n_shots").cast("string"), F.lit(" shots, rallies: "), F.col("n_rallies").cast("string"), F.lit(" ("),
        clock("rally_seconds"), F.lit(" of play, "), percent(F.col("rally_seconds") / F.greatest("duration", F.lit(1e-9))), F.lit(" of the video)"),
    )
    names = list(REPORT_STROKES.values())
    lines = F.concat(
        F.array(F.concat(F.lit("# Match report: "), "title"), F.lit(""), facts, F.lit("")),
        text(F.when(F.coalesce("score", F.lit("")) != "", F.concat(F.lit("Score as read: "), "score"))), text(F.col("story"), "## Course", ""), text(F.col("summary"), "## Summary", ""),
        table("teams", "## Teams"),
        table("players", "## Players", "| Player | Hits | Distance | Mean speed | Net | Transition | Back |", "|---|---|---|---|---|---|---|"),
        table("strokes", "## Strokes", "| Player | " + " | ".join(names) + " |", "|---|" + "---|" * len(names)),
        table("points", "## Points"),
    )
    return out.select(by, F.array_join(lines, "\n").alias("markdown"))
