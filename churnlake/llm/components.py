"""Connected components of an edge table by alternating star contraction, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import cut


def components(edges: DataFrame, rounds: int = 60, settled: bool = True) -> DataFrame:
    """(node, label): the smallest node of its component, for every node that an edge names.

    ``edges`` has long columns x and y. Each round hangs the larger neighbours of every node, then the
    smaller ones, on the smallest of them; the number of rounds is about the logarithm of the longest
    path. Nothing but counts comes to the driver; every round is a written table. With ``settled`` false
    the rounds may end early: nodes of one label then are connected, but not all connected ones have one label.
    """
    now = cut(edges.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.first("x"), F.min("y")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # every x is now larger than its y
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y")
        now = cut(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "edges")
        if not settled:
            continue
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        if settled:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    named = now.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("label")))
    return named.groupBy("node").agg(F.min("label").alias("label"))
