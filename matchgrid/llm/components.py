"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, materialize


#: Links that one task may hold, at some 20 bytes each; beyond, the links of a hub are spread.
ONE_TASK = 1_000_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, root`` for every node of the links ``u, v`` (long); root is the smallest node.

    Each round is two aggregations with partial sums and two joins; where there are more
    links than ``one_task``, these are by ``join_keyed`` and no task holds the
    links of a hub. The rounds grow with the logarithm of the nodes.
    Every round is written to the shared folder. Self links and repeated links
    are harmless; a null end drops the link; no links give an empty result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialize(e.where("u <> v and u is not null and v is not null").distinct(), "cc")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.where("v > u")
        # A node without larger neighbours has nothing to hand on.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.when(F.expr("v > u"), 1)).alias("n_rows"))
        low = low.where("n_rows > 0")
        spread, old = state[0] > one_task, (e,)
        if spread:
            low = materialize(low, "cc-low")
        large = (join_keyed(up, low, "u") if spread else up.join(low, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if spread:
            large = materialize(large, "cc-large", instead_of=(low,))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
        if spread:
            least = materialize(least, "cc-low")
            old = (e, large, least)
        small = (join_keyed(large, least, "u") if spread else large.join(least, "u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        e = materialize(small.unionByName(own).distinct(), "cc", instead_of=old)
        now = _state(e)
        if now == state:
            break
        state = now
    leaves = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return leaves.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
