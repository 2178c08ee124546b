"""Findings of round r03 on descriptions (F14, F15)."""

from matchgrid.operators import timeline


def test_frames_meet_their_segments_without_a_shuffle(spark):
    videos = spark.createDataFrame([(1, 12.0), (2, 0.3), (3, 720.0), (4, 0.0), (5, 10.0)], "video_key long, duration double")
    got = timeline.framed_segments(videos, 1.0, 5.0)
    old = timeline.assign_frames(timeline.frame_grid(videos, 1.0), timeline.plan_segments(videos, 5.0), 5.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
