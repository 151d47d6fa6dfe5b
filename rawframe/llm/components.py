"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of the edges (a, b) with the least node it is connected to.

    Each half round replaces a node's edges by edges to its least neighbour; the number of
    rounds grows with the logarithm of a component's size. Least neighbours are aggregated
    before they are exchanged, and a node with very many edges is split by the skewed join."""
    now = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        out = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        now = stage_table(out, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
