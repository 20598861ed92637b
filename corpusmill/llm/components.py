"""Connected components of a set of links, as alternating star contractions in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """links(a, b) -> (node, root): root is the smallest node reachable; every node of a link comes out once.

    Large-star and small-star steps: a round hangs each node's neighbours under its smallest neighbour, so the
    rounds grow with the logarithm of the longest chain. Minima are pre-aggregated before the shuffle and joined
    back, so no adjacency list is ever gathered in one task. Each round is written to the shared checkpoint
    folder, which survives lost executors. No links give no rows; loops and repeated links are harmless.
    """
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
