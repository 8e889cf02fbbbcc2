"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut, spent


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node u looks at its neighbours, and the least of them and itself gets linked to those above u (large) or not above (small)."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is the end of one edge, or only the beginning of some: stars of which nothing hangs together any more."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("node", "as_u", "as_v"))
    return ends.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v")).where("as_u + as_v > 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node it is linked with over any number of edges.

    Each round is a few joins on a node, whose large groups Spark splits; a round's edges are written to the shared
    checkpoint folder. The rounds grow with the logarithm of the longest path. Null ends are ignored.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    for _ in range(most_rounds):
        if _settled(edges):
            break
        last, edges = edges, cut(_star(_star(edges, small=False), small=True))
        spent(last)
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
