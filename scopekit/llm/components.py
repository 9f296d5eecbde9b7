"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for every node of an edge (a, b), the smallest node it is connected with.

    Each round every node points to its smallest neighbour (or itself), pointers are followed to their ends by
    doubling (so a chain of any length takes one round of about log2 of it joins), edges are replaced by the
    edges between those ends, and labels follow; rounds go on until no edge is left. Ends are no neighbours of each
    other, so the nodes that are left shrink quickly. Minima are combined before the shuffle, tables of a round are written, so joins
    read plain tables and a hot node's share of a join can be split by adaptive execution.
    """
    both = edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    edges = written(both.distinct(), "edges")
    labels = None
    while True:
        point = _followed(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        if labels is None:
            labels = point.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            labels = written(labels.join(point, labels["label"] == point["a"], "left")
                             .select("node", F.coalesce("p", "label").alias("label")), "labels")
        half = edges.join(point, "a").select(F.col("p").alias("x"), "b")
        to = point.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = written(half.join(to, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _followed(point: DataFrame) -> DataFrame:
    """(a, p) with every pointer moved on to the end of its chain, doubling the steps taken each time."""
    point = written(point.select("a", "p", (F.col("a") != F.col("p")).alias("open")), "pointers")
    while True:
        to = point.select(F.col("a").alias("x"), F.col("p").alias("q"))
        # an end points to itself; only pointers that moved last time can move again
        moved = point.join(to, F.col("p") == F.col("x")).select("a", F.col("q").alias("p"), (F.col("open") & (F.col("p") != F.col("q"))).alias("open"))
        point = written(moved, "pointers")
        if point.where("open").isEmpty():
            return point.select("a", "p")
