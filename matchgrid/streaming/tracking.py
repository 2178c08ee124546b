"""Tracking of players over a stream of detections, with the last positions of each shot as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchgrid.operators.motion import REACH, SPEED, follow

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["video_key", "shot_id", "frame", "slot", "x", "y"]
SCHEMA = "video_key string, shot_id long, frame long, slot int, x double, y double"


class Tracker(StatefulProcessor):
    """Frames wait until the watermark has passed them, then follow the last positions in order.

    State of a shot: the last position of each slot, and detections of frames that may still
    get more. A timer stands at the earliest waiting frame; where none waits, it
    stands ``idle`` after the last frame and ends the shot.
    """

    def __init__(self, fps: float, reach: float, speed: float, idle_ms: int):
        self.fps, self.reach, self.speed, self.idle = fps, reach, speed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "slot int", "x double, y double, frame long")
        self.waiting = handle.getMapState("waiting", "frame long", "ms long, x array<double>, y array<double>, conf array<double>")
        self.ended = handle.getValueState("ended", "ms long")

    def wait(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for frame, f in part.groupby("frame"):
                held = self.waiting.getValue((int(frame),)) if self.waiting.containsKey((int(frame),)) else (0, [], [], [])
                more = [list(held[k]) + f[c].astype(float).tolist() for k, c in ((1, "x"), (2, "y"), (3, "conf"))]
                self.waiting.updateValue((int(frame),), (max(int(held[0]), int(f["ms"].max())), *more))
        # A timer that the watermark has passed already would never come.
        self.wait(max(min(v[0] for _, v in self.waiting.iterator()), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((k[0], v) for k, v in self.waiting.iterator())
        ready = [(frame, v) for frame, v in waiting if v[0] <= now]
        last = {k[0]: (v[0], v[1], v[2]) for k, v in self.last.iterator()}
        out = []
        for frame, (_, x, y, conf) in ready:
            out += [(*key, frame, *t) for t in follow(last, frame, list(zip(x, y, conf, strict=True)), self.fps, self.reach, self.speed)]
            self.waiting.removeKey((frame,))
        for slot, place in last.items():
            self.last.updateValue((slot,), place)
        rest = [v[0] for frame, v in waiting if v[0] > now]
        if ready:
            self.ended.update((max(v[0] for _, v in ready) + self.idle,))
        if rest:
            self.wait(min(rest))
        elif self.ended.exists() and self.ended.get()[0] > now:
            self.wait(self.ended.get()[0])
        else:
            self.last.clear()
            self.ended.clear()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, fps: float, late: str = "2 seconds", idle_seconds: float = 60.0, reach: float = REACH, speed: float = SPEED) -> DataFrame:
    """``video_key, shot_id, frame, slot, x, y``, as ``track_players`` gives them, of a stream.

    detections: ``video_key, shot_id, frame, ts, x, y, conf``; ``ts`` is the frame's time, of one clock for all shots.
    A frame is settled when the watermark, ``late`` behind the newest one, has passed it;
    detections that come later than that are dropped. A shot that has no frame for
    ``idle_seconds`` is over, and its state goes. The session's state store has to be RocksDB.
    """
    if ROCKS not in (detections.sparkSession.conf.get(PROVIDER, None) or ""):
        raise ValueError(f"{PROVIDER} has to be {ROCKS}")
    timed = detections.withWatermark("ts", late)
    rows = timed.select("video_key", F.col("shot_id").cast("long").alias("shot_id"), F.col("frame").cast("long").alias("frame"), "ts", F.unix_millis("ts").alias("ms"), "x", "y", "conf")
    return rows.groupBy("video_key", "shot_id").transformWithStateInPandas(
        statefulProcessor=Tracker(fps, reach, speed, int(1000 * idle_seconds)), outputStructType=SCHEMA, outputMode="append", timeMode="eventTime"
    )
