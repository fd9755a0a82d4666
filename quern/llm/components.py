"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins; a node's neighbours are never gathered in one place, so a hub with
a third of all edges is only a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node linked to a lesser one; root is the least node of its component.

    `edges` has two bigint columns `u` and `v`. Self-loops and edges with a null end are ignored, repeated edges count
    once; an empty table gives an empty result. Nodes that are their own root are not listed.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    for _ in range(rounds):
        then = cut(_small_star(_large_star(now)).distinct())
        new = then.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        now = then
        if new == sign or new[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
