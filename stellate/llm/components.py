"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import joined, written


def _settled(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` that is no ``u`` itself: then ``v`` is its component."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    ends = edges.select(F.col("v").alias("u")).distinct()
    return ends.join(edges.select("u").distinct(), "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``); the component is its least node.

    Each round links every node's larger neighbours to its least neighbour (large star), then its smaller
    ones (small star), until all are stars.  Only minima by node and joins back are needed: minima are
    made before the shuffle, and the joins broadcast what hubs need (:func:`joined`), so no node is a group
    of its own in a task.  Rounds are written, not kept in lineage.  Loops, repeated edges and null ends are
    dropped.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct()
    edges = written(edges, "edges")
    rounds = 0
    while not _settled(edges):
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n"))
        least = written(least.where("n > 0").select("u", F.least("u", "m").alias("m"), "n"), "least")
        total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        large = joined(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        small = joined(large, least, "u", total).select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
