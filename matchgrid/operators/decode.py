"""Hits from sounds and movement: alternation decoding, nearest positions, stroke rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.session import partitions_of

NO_HIT = 3.0
MIN_GAP_S = 0.45


def alternate_hits(candidates: DataFrame, no_hit: float = NO_HIT, gap: float = MIN_GAP_S) -> DataFrame:
    """``video_key, cand, team``: the best series of hits in which teams alternate.

    A dynamic program over the candidates of a video in order: the best value
    and time of the last hit for each last team (2: none yet), with pointers
    back that are followed once at the end. A choice is a hit by the other
    team, at least ``gap`` after the last, or no hit, which is worth
    ``no_hit``. Of equal values the first in the order kept before (no team,
    far, near) stays.
    """
    rows = candidates.groupBy("video_key").agg(
        F.array_sort(F.collect_list(F.struct("t", "cand", "s0", "s1"))).alias("c")
    )
    cand = candidates.schema["cand"].dataType

    def choose(c: list[dict]) -> list[int | None]:
        # Per last team (0, 1, or 2 for none yet): value and time of the last hit; each
        # step keeps where every state came from and with which choice.
        value, last, steps = {2: 0.0}, {2: -1e9}, []
        for x in c:
            nxt: dict[int, tuple[float, float, int, int | None]] = {}
            for state in [k for k in (2, 0, 1) if k in value]:
                options = [(state, no_hit, last[state], None)]
                options += [(k, x[f"s{k}"], x["t"], k) for k in (0, 1) if k != state and x["t"] - last[state] >= gap]
                for to, gain, t, choice in options:
                    if to not in nxt or value[state] + gain > nxt[to][0]:
                        nxt[to] = (value[state] + gain, t, state, choice)
            value, last = {k: v[0] for k, v in nxt.items()}, {k: v[1] for k, v in nxt.items()}
            steps.append({k: v[2:] for k, v in nxt.items()})
        state, path = max((k for k in (2, 0, 1) if k in value), key=lambda k: value[k]), []
        for step in reversed(steps):
            state, choice = step[state]
            path.append(choice)
        return path[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A batch holds many videos, of which one at a time is made of Python's objects.
            paths = [choose(c.as_py()) for c in b.column("c")]
            yield pa.RecordBatch.from_arrays([b.column("video_key"), b.column("c"), pa.array(paths, pa.list_(pa.int32()))], ["video_key", "c", "p"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    got = rows.mapInArrow(run, f"video_key {kinds['video_key']}, c {kinds['c']}, p array<int>")
    return got.select("video_key", F.posexplode("c").alias("k", "x"), "p").select(
        "video_key", F.col("x.cand").cast(cand).alias("cand"), F.expr("p[k]").alias("team")
    )


def nearest_position(points: DataFrame, tracks: DataFrame) -> DataFrame:
    """Known position nearest in frames to each of ``shot_id, slot, frame``; ties go to the earlier.

    Two running windows over the union of points and positions, one in either
    direction; no range join.
    """
    key = ["shot_id", "slot"]
    a = points.select(*key, "frame", F.lit(True).alias("ask"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y")])
    b = tracks.where("x is not null").select(*key, "frame", F.lit(False).alias("ask"), "x", "y")
    u = a.unionByName(b)
    known = F.when(F.col("x").isNotNull(), F.struct("frame", "x", "y"))
    upward, downward = (Window.partitionBy(*key).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in ("frame", F.desc("frame")))
    u = u.withColumns({"p": F.last(known, True).over(upward), "q": F.last(known, True).over(downward)}).where("ask")
    near = F.when(F.col("q").isNull() | (F.col("frame") - F.col("p.frame") <= F.col("q.frame") - F.col("frame")), F.col("p")).otherwise(F.col("q"))
    return u.withColumn("near", near).where("near is not null").select(*key, "frame", "near.x", "near.y")


def strongest_slot(candidates: DataFrame, speeds: DataFrame, fps: float, before: float = 0.2, after: float = 0.1) -> DataFrame:
    """Fastest slot of each team around each sound: ``cand, team, slot, frame, speed``.

    A sound names the few frames of its window, so the band join is an equi-join. A frame
    joins as one row, with its fastest slot of either team. Frames of sounds take little
    room but many rows, so partitions go by their number.
    """
    low = F.greatest(F.lit(0), ((F.col("t") - before) * fps).cast("bigint"))
    high = ((F.col("t") + after) * fps).cast("bigint")
    cut = candidates.where(low <= high).select("shot_id", "cand", F.explode(F.sequence(low, high)).alias("frame"))
    n, by = partitions_of(cut), ("shot_id", "frame")
    best = [F.max(F.when((F.col("slot") < 2) == (team == 0), F.struct("speed", (-F.col("slot")).alias("s")))).alias(f"b{team}") for team in (0, 1)]
    fastest = speeds.repartition(n, *by).groupBy(*by).agg(*best)
    j = cut.repartition(n, *by).join(fastest, [*by])
    first = [F.max(F.when(F.col(b).isNotNull(), F.struct(f"{b}.speed", f"{b}.s", (-F.col("frame")).alias("f")))).alias(b) for b in ("b0", "b1")]
    teams = F.explode(F.array(*[F.struct(F.lit(team).alias("team"), F.col(f"b{team}").alias("b")) for team in (0, 1)])).alias("t")
    found = j.groupBy("shot_id", "cand").agg(*first).select("shot_id", "cand", teams).where("t.b is not null")
    return found.select(
        "shot_id", "cand", "t.team", (-F.col("t.b.s")).alias("slot"), (-F.col("t.b.f")).alias("frame"), F.col("t.b.speed").alias("speed")
    )


#: The stroke names.
STROKES = (
    "service", "coup_droit", "revers", "volee_cd", "volee_revers", "bandeja", "vibora", "smash", "lob", "sortie_vitre",
)
#: Strokes above the head. The distances and confidences of the rules below are fixed too.
OVERHEAD = ("bandeja", "vibora", "smash")


def _names(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def allowed_strokes(height: str | Column, dist: str | Column) -> Column:
    """Strokes that fit a contact height (low, high or head) and a distance to the net; never empty."""
    h, d = (F.col(c) if isinstance(c, str) else c for c in (height, dist))
    ok = F.when(h == "low", F.array_except(_names(STROKES), _names(OVERHEAD))).when(
        h == "head", _names(OVERHEAD)
    ).otherwise(F.array_except(_names(STROKES), _names(("service",))))
    ok = F.when(d > 7.0, F.array_except(ok, _names(("volee_cd", "volee_revers")))).otherwise(ok)
    ground = ("coup_droit", "revers", "lob", "sortie_vitre", "service")
    ok = F.when(d < 3.0, F.array_except(ok, _names(ground))).otherwise(ok)
    return F.when(F.size(ok) == 0, _names(STROKES)).otherwise(ok)


def stroke_by_pose(hits: DataFrame) -> DataFrame:
    """``stroke, confidence`` by rule from measured columns of a hit.

    Columns: overhead, forehand (Boolean), dist, speed, first_in_shot, since_start,
    wrist_low (Boolean: wrist not above the waist by much).
    """
    serve = F.col("first_in_shot") & (F.col("since_start") < 2.5) & (F.col("dist") >= 6.45) & ~F.col("overhead") & F.col("wrist_low")
    rules = [
        (serve, "service", 0.6),
        (F.col("overhead") & (F.col("dist") < 5.0) & (F.col("speed") > 0.45), "smash", 0.5),
        (F.col("overhead") & (F.col("dist") >= 5.0) & (F.col("speed") < 0.35), "bandeja", 0.45),
        (F.col("overhead"), "vibora", 0.35),
        ((F.col("dist") < 4.5) & F.col("forehand"), "volee_cd", 0.6),
        (F.col("dist") < 4.5, "volee_revers", 0.6),
        (F.col("forehand"), "coup_droit", 0.6),
        (F.lit(True), "revers", 0.6),
    ]
    name, conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    for cond, n, c in reversed(rules):
        name, conf = F.when(cond, n).otherwise(name), F.when(cond, c).otherwise(conf)
    return hits.withColumns({"stroke": name, "confidence": conf})


def refine_with_answers(hits: DataFrame) -> DataFrame:
    """Applies a model's answer (``swing`` Boolean, ``answer`` string) to hits with
    stroke, confidence, evidence, height and dist; rejected hits go."""
    allowed = allowed_strokes("height", "dist")
    h = hits.where(~(F.coalesce(~F.col("swing"), F.lit(False)) & (F.col("evidence") < 2 * NO_HIT))).withColumn("allowed", allowed)
    named = F.array_contains(_names(STROKES), F.col("answer"))
    fits = F.coalesce(F.array_contains("allowed", F.col("answer")), F.lit(False))
    stroke = F.when(fits, F.col("answer")).when(F.array_contains("allowed", F.col("stroke")), F.col("stroke")).otherwise(F.col("allowed")[0])
    conf = F.when(fits, F.when(F.col("answer") == F.col("stroke"), 0.8).otherwise(0.6)).otherwise(F.col("confidence"))
    return h.withColumns({"stroke_model": F.when(named, F.col("answer")), "stroke": stroke, "confidence": conf}).drop("allowed")


def reconcile(hits: DataFrame) -> DataFrame:
    """Keeps a model's label only while it fits the measured pose; else the pose rule's."""
    fits = F.coalesce(F.array_contains(allowed_strokes("height", "dist"), F.col("stroke_model")), F.lit(False))
    return hits.withColumn("stroke", F.when(fits, F.col("stroke_model")).otherwise(F.col("stroke_pose")))


def apply_classifier(hits: DataFrame, trusted: bool = True, reject_over: float = 0.7) -> DataFrame:
    """Applies classifier answers (``label, prob``): surely no hit goes, the merged
    overhead class takes the model's overhead label, others overwrite if trusted."""
    no_hit = (F.col("label") == "pas_une_frappe")
    h = hits.where(~F.coalesce(no_hit & (F.col("prob") >= reject_over), F.lit(False)))
    merged = F.when(F.col("stroke_model").isin("bandeja", "vibora"), F.col("stroke_model")).otherwise("vibora")
    new = F.when(F.col("label").isNull() | no_hit, F.col("stroke")).when(F.col("label") == "bandeja_vibora", merged).otherwise(F.col("label"))
    conf = F.when(F.col("label").isNull() | no_hit, F.col("confidence")).otherwise(F.col("prob"))
    return h.withColumns({"stroke": new, "confidence": conf}) if trusted else h
