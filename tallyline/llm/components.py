"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.sources.scratch import written


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges in both directions, each with the least node of its first end's neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.join(least, "a")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; a component is named by its least node.

    Large-star and small-star rounds (each a join and an aggregation) until the edges no longer change; every round
    is written to the shared folder, so no lineage grows and nothing but two totals reaches the driver. Self loops
    and repeated edges are allowed; rows with a null end are left out; without edges the result is empty.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    before = None
    while True:
        large = _with_least(edges).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: the lesser neighbours of a node, and the node itself, go to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = written(
            small.union(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct(), "components"
        )
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_003)).cast("long"))
        ).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
