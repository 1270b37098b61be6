"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node that links reach.

    Each round hangs larger neighbours onto the smallest one (large star), then smaller ones (small star); the number
    of rounds grows with the logarithm of the longest path. Nodes without links do not appear; loops and repeated
    edges are harmless; an empty table gives an empty table. Nothing but two totals a round reaches the driver.
    """
    links = (
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    now, before = written(links, "links"), None
    for _ in range(max_rounds):
        # A written table is finite and its rows distinct, so equal totals and hashes mean that nothing changed.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
