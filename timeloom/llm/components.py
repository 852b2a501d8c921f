"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, look_up, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the smallest node that it reaches.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), each of which keeps the components: every node's
    larger (or smaller) neighbours are linked to its least neighbour. Ends when every edge leads to its component's least node.
    Each round is written to the shared folder and the one before it deleted. A node with a large part of all edges, as the root
    of a large component is, gets its edges' partners by broadcast, so that they don't meet in one task. Null ends and edges from
    a node to itself are ignored.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    while True:
        n = now.count()
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = look_up(both, least, ["a"], "n", 2 * n).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large, between = written(large, "edges")
        # small star: every edge (a, b) with a < b seen from its larger end
        down = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = look_up(large, down, ["b"], "n", n).select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y")
        now, after = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        for old in (path, between):
            discard(spark, old)
        path = after
        # done when no node is both a root and a member, and every member has one root
        if now.select("a").intersect(now.select("b")).isEmpty() and now.groupBy("b").count().where("count > 1").isEmpty():
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes linked by i-j the least node that each reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
