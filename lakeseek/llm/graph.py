"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs -> (node, root): each node that has a link, and the smallest node it can reach.

    Each round is two group-by-min steps and joins; no adjacency list is ever
    collected, so a hub is only a key whose rows Spark can split. Self links,
    doubled and reversed links are fine. Ends once a round changes nothing;
    lineage is cut by checkpoint() each round.
    """
    lo, hi = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    e = checkpointed(edges.where("a <> b").select(hi, lo).distinct())
    mark = None
    for _ in range(0 if e.isEmpty() else max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = checkpointed(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    else:
        if mark is not None:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
