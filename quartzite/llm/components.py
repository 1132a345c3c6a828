"""Connected components of an edge table, in rounds of contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (numbers). One row (node, root) for each node of an edge between two different nodes; root is the smallest node reached.

    In each round every node points to its smallest neighbour, pointers are doubled until they reach roots, and edges are
    rewritten to roots; what is left is the graph of roots. A null end is no edge; repeated edges count once.
    """
    edges = materialise(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while True:
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        parent = materialise(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = materialise(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parents")
            moved = higher.where("moved").limit(1).count()
            discard(parent)
            parent = higher.select("node", "root")
            if not moved:
                break
        left, right = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        rest = materialise(edges.join(left, "a").join(right, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        found = parent if found is None else found.join(parent.toDF("root", "above"), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        discard(edges)
        edges = rest
        if not edges.limit(1).count():
            return found
