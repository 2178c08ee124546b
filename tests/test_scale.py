"""Plans and figures that have to hold on large tables, and ties that SQL decides."""

import contextlib
import io

from matchgrid import session
from matchgrid.operators import decode, hits, motion, timeline


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_exploded_frames_are_not_broadcast(spark):
    videos = spark.range(20).selectExpr("id AS video_key", "12D AS duration")
    grid = timeline.frame_grid(videos, 1.0)
    frames = timeline.assign_frames(grid, timeline.plan_segments(videos, 5.0), 5.0)
    assert "BroadcastHashJoin" not in plan_of(frames)
    assert frames.count() == 240
    assert frames.where("video_key = 3 AND seg_id = 2").count() == 2


def test_equal_sums_of_distances_as_in_sql():
    # The other order's sum is the same on paper; a hypotenuse rounded in another way swaps the slots.
    last: motion.Last = {0: (0.0, 1.6, 0), 1: (2.0, 1.6, 0)}
    found = [(0.0, 2.4000000000000004, 0.9), (0.0, 0.8, 0.8)]
    assert motion.follow(last, 1, found, 30) == [(0, 0.0, 2.4000000000000004), (1, 0.0, 0.8)]


def test_dealt_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PARTITION_ROWS", 50)
    rows = session.dealt(spark.range(1000).selectExpr("id", "id div 10 AS shot_id"), "shot_id")
    counts = rows.groupBy("shot_id").count()
    assert rows.rdd.getNumPartitions() == 20
    # What is grouped by the same key stays in these partitions.
    assert plan_of(counts).count("Exchange") == 1
    assert counts.where("count = 10").count() == 100


def test_a_frame_joins_once_for_all_its_slots(spark):
    cands = spark.createDataFrame([(1, 7, 0.5)], "shot_id long, cand long, t double")
    speeds = spark.createDataFrame([(1, s, f, float(v)) for f in (12, 13) for s, v in ((0, 4), (1, 4), (2, 1), (3, 5))], "shot_id long, slot int, frame long, speed double")
    out = decode.strongest_slot(cands, speeds, 30.0)
    assert sorted(out.select("team", "slot", "frame", "speed").collect()) == [(0, 0, 12, 4.0), (1, 3, 12, 5.0)]
    assert "Generate" in plan_of(out) and plan_of(out).index("max(CASE") > 0


def test_only_what_is_measured_meets_the_hits(spark):
    kpts = "transform(sequence(0, 16), k -> named_struct('x', k * 3D, 'y', k * 5D, 'c', 0.9D)) AS kpts"
    poses = spark.range(40).selectExpr("1L AS shot_id", "0 AS slot", "id AS frame", kpts)
    found = spark.createDataFrame([(1, 0, 20, "right"), (1, 0, 99, "left")], "shot_id long, slot int, frame long, arm string")
    out = hits.pose_measures(found, poses)
    plan = plan_of(out)
    # Neither keypoints nor frames around the hits are shuffled: no row of a hit is multiplied.
    assert "Generate" not in plan and plan.count("Join") == 1
    assert out.select("frame", "height", "overhead").collect() == [(20, "low", False)]
