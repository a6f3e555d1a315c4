"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.sources.shared import stash

def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    lowest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of the undirected ``edges`` (a, b).

    Each round is a pair of groupings with partial aggregation, and joins by node, which adaptive execution may split: a hub's edges
    (narrow rows of two numbers) meet in one task unless it does.
    Rounds needed grow with the logarithm of the longest path. Lineage is cut by a written table each round. Self loops give a component of
    one node; repeated edges count once; an edge with a null end is left out; no edges give no rows.
    """
    edges = stash(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "components")  # read twice below; whatever made it runs once
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    now = edges.where("a <> b").distinct()
    seen = None
    for _ in range(max_rounds):
        now = stash(_small_star(_large_star(now)), "components")
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
