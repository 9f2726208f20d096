"""Connected components of a graph given as rows of pairs, by alternating stars.

Each round every node points its larger neighbours, then its smaller ones, at the smallest node it
sees; the number of rounds grows with the logarithm of the graph's size.  Only DataFrame operations;
each round is written to the shared folder, so a lost executor costs one round at most, and the one
before is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import dropped, stored

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of edges(a, b), root being the smallest node of the component."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    for _ in range(ROUNDS):
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now, before = stored(small, "edges"), now
        dropped(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
