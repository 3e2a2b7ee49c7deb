"""Connected components of an edge table, without bringing edges to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.session import materialize


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, root`` for each end of an edge ``a, b``; ``root`` is the least node of its component.

    Large star and small star in turn: each round links every node to the least neighbour, so the number
    of rounds grows with the logarithm of the size of a component. Self loops are kept as nodes.
    Stops with an error if ``rounds`` do not suffice.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    now = materialize(pairs.where("a < b"))
    for _ in range(rounds):
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("x"), F.col("b").alias("y"))
        large = large.where("x <> y").distinct()
        up = large.groupBy("y").agg(F.min("x").alias("m"))
        small = large.join(up, "y").select(F.col("m").alias("a"), F.col("x").alias("b")).union(up.select(F.col("m"), F.col("y")))
        new = materialize(small.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if now.exceptAll(new).isEmpty() and new.exceptAll(now).isEmpty():
            break
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def follow_parents(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each row of ``node, parent``: where the chain of parents ends. Chains must not turn in circles.

    Each round doubles the distance covered (pointer jumping); nodes that have arrived are set aside.
    """
    now = materialize(links.select("node", F.col("parent").alias("root")))
    for _ in range(rounds):
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        new = materialize(now.join(ahead, "root", "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = new.where("_moved").limit(1).count()
        now = new.drop("_moved")
        if not moved:
            return now
    raise RuntimeError(f"chains did not end in {rounds} rounds")
