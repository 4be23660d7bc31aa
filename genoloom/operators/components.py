"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.session import drop_materialized, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that touches an edge; root is the smallest node reachable.

    Edges with a null end and self-loops of otherwise unlinked nodes are ignored. Every round is a handful of
    equi-joins and partial aggregates whose result goes to the shared folder, so lineage stays short and a hub
    node never has to fit in one task. Rounds grow with the logarithm of the graph; ``max_rounds`` only guards
    against a graph that does not settle and raises rather than returning a wrong answer.
    """
    low, high = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    current = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high, low).distinct(), "cc-edges")
    before = _mark(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # Large star: every neighbour above u hangs on u's least neighbour (or on u). What is joined to the edges is written
        # first, so that both sides of each join have a shuffle of their own and Spark can split a hub's edges.
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = materialize(large.distinct(), "cc-large")
        # Small star: every neighbour below u, and u, hang on u's least neighbour.
        floor = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-floor")
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(floor.select("u", F.col("m").alias("v")))
        after = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
        for done in (least, large, floor):
            drop_materialized(done)
        now = _mark(after)
        drop_materialized(current)
        current = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: two scalars for the loop test."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
