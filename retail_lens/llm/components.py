"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node that edges lead to.

    Each round points all larger neighbours of a node to its least neighbour (large star), then all smaller ones (small star);
    it ends when the edges stay as they are, which they do once every component is a star. The least neighbours are found
    with map-side minima and written down before they are joined, so that a join splits a node with very many edges.
    Self-loops, repeated edges and edges with a null end add nothing; an empty table gives an empty one.
    """
    now = common.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = common.materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        below = common.materialize(large.groupBy("a").agg(F.min("b").alias("m")), "below")
        small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(below.select("a", F.col("m").alias("b")))
        nxt = common.materialize(small.distinct(), "edges")
        new = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        for x in (now, least, large, below):
            common.drop(x)
        now = nxt
        if new == state:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        state = new
