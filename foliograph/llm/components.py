"""Connected components of an edge table by alternating large and small stars.

Every round is a few aggregations and joins over edges; nothing is collected, and
each round's edges are written to the shared folder, so a lost executor repeats
only its tasks. A node with a third of all edges is met by partial aggregation on
one side and by a join on plain keys, which adaptive execution splits, on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph.workspace import written

#: Rounds grow with the logarithm of the longest chain; far beyond any that fits a cluster.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of ``edges`` (a, b); null ends and loops are ignored."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    for _ in range(MAX_ROUNDS):
        # done when the edges are stars: no node has two parents, no parent is a child
        if not e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").take(1) and not e.select("v").join(e.select(F.col("u").alias("v")), "v", "left_semi").take(1):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that the join meets two plain tables and a node with many edges can be split
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "minima")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = written(small.filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
