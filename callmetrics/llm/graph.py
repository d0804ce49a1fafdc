"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.common import cut


def _normal(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the larger end first."""
    return pairs.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether the pairs are stars around the smallest node of each: a larger end has one pair and is no smaller end."""
    ends = pairs.select(F.col("x").alias("node"), F.lit(1).alias("large"), F.lit(0).alias("small"))
    ends = ends.unionByName(pairs.select(F.col("y").alias("node"), F.lit(0).alias("large"), F.lit(1).alias("small")))
    seen = ends.groupBy("node").agg(F.sum("large").alias("large"), F.max("small").alias("small"))
    return not seen.where("large > 1 or (large = 1 and small = 1)").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Rows (node, root): the smallest node of each node's component, for nodes with an edge to another.

    Alternates large-star steps (larger neighbours move to the smallest neighbour) and small-star steps (smaller
    neighbours and the node itself do) until every edge leads to a root; edges that are stars already take no round.
    The minimum of a node's neighbours is an aggregate that combines before the shuffle, so no node's neighbours are
    gathered; each step is checkpointed once.
    """
    named = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null")
    found = cut(_normal(named))
    for _ in range(most_rounds):
        if _settled(found):
            break
        both = found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = cut(_normal(both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))))
        moved = large.join(large.groupBy("x").agg(F.min("y").alias("m")), "x")
        found = cut(_normal(moved.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(moved.select("x", F.col("m").alias("y")))))
    else:
        raise RuntimeError("components did not settle")
    return found.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(found.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
