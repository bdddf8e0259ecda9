"""Connected components by alternating large-star and small-star steps.

Every step is two joins over the edge list; nothing is gathered on the driver
but a count and a checksum.  A star's centre may have any number of edges: its
minimum comes from a partial aggregate, and the join back is one that adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import stage, unstage


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node with an edge; a component is its least node.

    ``edges`` has long columns ``u`` and ``v``; loops and repeats are ignored,
    no edges give no rows.
    """
    now = stage(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = _sum(now)
    while before[0]:
        after = stage(_small_star(_large_star(now)), "edges")
        unstage(now)
        now, seen = after, _sum(after)
        if seen == before:
            break
        before = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
