"""Connected components of a graph in Spark, whatever its size or shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflow.runtime import materialise


def _linked(edges: DataFrame) -> DataFrame:
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return edges.where(F.col("a") != F.col("b")).select(low, high).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (a, b): the root is the smallest node it can reach.

    Each round hangs every node under its smallest neighbour, follows those
    links to their ends by doubling, and replaces nodes by the ends, so the graph
    shrinks by half or more and long chains take few rounds. Neighbours are
    reduced to a minimum within tasks first, so a node with very many links is no
    heavier than others. Rounds are written to the shared folder. Edges with a
    null end and loops link nothing.
    """
    edges = materialise(_linked(edges), "links")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")), "parents")
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = materialise(parent.join(above, "root").select(
                "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parents")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = parent
        else:
            ends = parent.select(F.col("node").alias("root"), F.col("root").alias("end"))
            found = materialise(found.join(ends, "root", "left").select(
                "node", F.coalesce("end", "root").alias("root")), "roots")
        at_a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = materialise(_linked(edges.join(at_a, "a").join(at_b, "b").select(
            F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
