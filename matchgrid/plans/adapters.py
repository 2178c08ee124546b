"""Deterministic views of the driver's tables in the operators' input schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchgrid.session import dealt, table

SEGMENT_S = 5.0
MATCH_S = 720.0


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_key, utt_id, start, end, text`` from events."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "user_id AS video_key",
            "event_id AS utt_id",
            "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3600D AS start",
            "event_type AS text",
        )
        .selectExpr("video_key", "utt_id", "start", "start + 0.5D + (utt_id % 40) / 8D AS end", "text")
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_key, b, e`` from the view and click events."""
    spoken = utterances(spark, sf_dir).where("text IN ('view', 'click')")
    return spoken.selectExpr("video_key", "start - 0.125D AS b", "start + 2D AS e")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_key, duration, width, height`` from part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS video_key",
        "p_size * 1.25D AS duration",
        "cast(320 + (p_partkey % 37) * 53 AS int) AS width",
        "cast(240 + (p_partkey % 23) * 37 AS int) AS height",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_key, frame, hist`` (normalized) and the raw vector from embeddings."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 128 AS video_key",
        "vec_id AS frame",
        "transform(embedding, x -> cast(x AS double)) AS vec",
    )


def shot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem by shots, in which its frames are numbered; all steps by shot stay in these partitions."""
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey div 400")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shot_id, slot, frame, x, y`` from lineitem; a third of the positions is missing."""
    return shot_rows(spark, sf_dir).selectExpr(
        "l_orderkey div 400 AS shot_id",
        "cast(l_linenumber % 4 AS int) AS slot",
        "cast(row_number() OVER (PARTITION BY l_orderkey div 400, l_linenumber % 4 ORDER BY l_shipdate, l_orderkey, "
        "l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS bigint) AS frame",
        "if(l_returnflag = 'N', NULL, l_discount * 100D) AS x",
        "if(l_returnflag = 'N', NULL, l_quantity * 0.4D) AS y",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video_key, cand, t, s0, s1``: sounds with a score for either team, from events."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "user_id AS video_key",
        "event_id AS cand",
        "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 72000D AS t",
        "cast(floor(value) AS bigint) % 8 AS s",
    )
    return ev.selectExpr(
        "video_key", "cand", "t", "if(cand % 2 = 0, s * 1D, 1D) AS s0", "if(cand % 2 = 0, 1D, s * 1D) AS s1"
    )


def score_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``match, ord, games, points`` per customer, in order of their orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS match",
        "cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS int) AS ord",
        "array(array(cast(o_orderkey div 4 % 7 AS int)), array(cast(o_orderkey div 24 % 7 AS int))) AS games",
        "array(element_at(array('0','15','30','40','A','7'), cast(o_orderkey % 6 AS int) + 1), "
        "element_at(array('0','15','30','40'), cast(o_orderkey div 7 % 4 AS int) + 1)) AS points",
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``video, key, truth, pred, vlm, pose`` from documents and labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "source AS video",
        "doc_id AS key",
        "concat('c', quality + toxic) AS truth",
        "concat('c', if(n_chars > 1000, 1, 0) + if(n_chars > 4000, 1, 0)) AS pred",
        "if(lang = 'en', concat('c', doc_id % 3), NULL) AS vlm",
        "nullif(if(doc_id % 5 = 0, '', concat('c', n_chars % 2)), '') AS pose",
    )


FRAME = (
    "cast(row_number() OVER (PARTITION BY l_orderkey div 400, l_linenumber % 4 ORDER BY l_shipdate, l_orderkey, "
    "l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS bigint) AS frame"
)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shot_id, slot, frame, kpts`` (17 of x, y, c) on the frames of ``tracks``."""
    return shot_rows(spark, sf_dir).selectExpr(
        "l_orderkey div 400 AS shot_id",
        "cast(l_linenumber % 4 AS int) AS slot",
        FRAME,
        "transform(sequence(0, 16), k -> named_struct('x', l_partkey * (k + 3) % 97 * 2D, 'y', l_suppkey * (k + 5) % 89 * 2D + k * 4, "
        "'c', l_partkey * (k + 1) % 10 / 10D)) AS kpts",
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as ``detect_hits`` gives them, on every fifth frame of the tracks."""
    rows = shot_rows(spark, sf_dir).selectExpr(
        "l_orderkey div 400 AS shot_id", "cast(l_linenumber % 4 AS int) AS slot", FRAME, "l_quantity", "l_discount", "l_suppkey", "l_partkey"
    )
    return rows.where("frame % 5 = 0").selectExpr(
        "shot_id", "frame / 30D AS t", "frame", "slot", "if(slot < 2, 'far', 'near') AS side", "l_discount * 100D AS x", "l_quantity * 0.4D AS y",
        "abs(l_quantity * 0.4D - 10) AS dist_net", "l_discount * 6D AS speed", "l_quantity / 4D AS evidence", "if(l_suppkey % 2 = 0, 'right', 'left') AS arm",
        "'pose' AS source",
    )


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shot_id, start, end`` of the shots of ``tracks``."""
    ids = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 400 AS shot_id").distinct()
    return ids.selectExpr("shot_id", "shot_id * 20D AS start", "shot_id * 20D + 15D AS end")


def wrist_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrists, their sureness and body heights, on the frames of ``tracks``."""
    return shot_rows(spark, sf_dir).selectExpr(
        "l_orderkey div 400 AS shot_id", "cast(l_linenumber % 4 AS int) AS slot", FRAME, "l_quantity AS lx", "l_discount * 100 AS ly",
        "l_tax * 10 AS lc", "cast(l_partkey % 97 AS double) AS rx", "cast(l_suppkey % 53 AS double) AS ry", "l_discount * 8 AS rc", "l_quantity * 4 AS height",
    )
