"""Tracking as a stream against the same over whole shots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid.operators import motion
from matchgrid.streaming import tracking

SCHEMA = "video_key string, shot_id long, frame long, ts timestamp, x double, y double, conf double"


def walks(video, shot, n, seed):
    """Four players on walks, some unseen for a while, some frames with more detections than players."""
    rng = np.random.default_rng(seed)
    place = np.array([[3.0, 4], [7, 5], [3, 15], [7, 16]])
    rows = []
    for frame in range(n):
        place = np.clip(place + rng.normal(0, 0.15, (4, 2)), 0, [10, 20])
        for k in range(4):
            if rng.random() < 0.85:
                rows.append((video, shot, frame, *place[k].tolist(), float(rng.choice([0.5, 0.7, 0.9]))))
        if rng.random() < 0.2:
            rows.append((video, shot, frame, *rng.uniform([0, 0], [10, 20]).tolist(), 0.6))
    return rows


@pytest.fixture()
def rocks(spark):
    spark.conf.set(tracking.PROVIDER, tracking.ROCKS)
    yield
    spark.conf.unset(tracking.PROVIDER)


def test_frame_by_frame():
    last: motion.Last = {}
    assert motion.follow(last, 0, [(7.0, 3.0, 0.9), (2.0, 3.0, 0.8), (1.0, 2.0, 0.1), (5.0, 12.0, 0.5)], 25) == [(0, 2.0, 3.0), (1, 7.0, 3.0), (2, 5.0, 12.0)]
    assert motion.follow(last, 1, [(6.0, 3.0, 0.5), (3.0, 3.0, 0.9)], 25) == [(0, 3.0, 3.0), (1, 6.0, 3.0)]
    # Too far for one frame, near enough after two seconds unseen.
    assert motion.follow(dict(last), 2, [(9.5, 19.0, 0.9)], 25) == [(3, 9.5, 19.0)]
    assert motion.follow({2: (5.0, 12.0, 0), 3: (6.0, 12.0, 0)}, 1, [(1.0, 18.0, 0.9)], 25) == []
    assert motion.follow({2: (5.0, 12.0, 0), 3: (6.0, 12.0, 0)}, 50, [(1.0, 18.0, 0.9)], 25) == [(2, 1.0, 18.0)]
    assert motion.follow({}, 0, [], 25) == []


def test_stream_equals_batch_over_a_restart(spark, rocks, tmp_path):
    rows = walks("a", 1, 40, 1) + walks("a", 2, 25, 2) + walks("b", 1, 30, 3)
    base = {("a", 1): 100, ("a", 2): 103, ("b", 1): 101}
    timed = [(v, s, f, base[v, s] + f / 25, x, y, c) for v, s, f, x, y, c in rows]
    order = sorted(timed, key=lambda r: r[3] + np.random.default_rng(int(r[2] * 97 + r[1])).uniform(0, 0.5))  # some frames come late
    df = lambda part: spark.createDataFrame(part, "video_key string, shot_id long, frame long, s double, x double, y double, conf double").select("video_key", "shot_id", "frame", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"), "x", "y", "conf")
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    parts = [order[len(order) * k // 4 : len(order) * (k + 1) // 4] for k in range(4)] + [[("end", 9, 0, 500.0, 1.0, 1.0, 1.0)], [("end", 9, 1, 900.0, 1.0, 1.0, 1.0)]]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = tracking.track_stream(stream, 25.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    for k, part in enumerate(parts):
        df(part).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 5):  # a second run goes on from the checkpoint
            run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).where("video_key <> 'end'").select(*tracking.COLUMNS).collect())
    want = []
    for video in "ab":
        shots = spark.createDataFrame([r[1:] for r in rows if r[0] == video], "shot_id long, frame long, x double, y double, conf double")
        want += [(video, *r) for r in motion.track_players(shots, 25.0).collect()]
    assert got == sorted(want) and len(got) > 250


def test_stream_needs_rocksdb(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'a' AS video_key", "value AS shot_id", "value AS frame", "timestamp AS ts", "1D AS x", "1D AS y", "1D AS conf")
    with pytest.raises(ValueError, match="RocksDB"):
        tracking.track_stream(stream, 25.0)
