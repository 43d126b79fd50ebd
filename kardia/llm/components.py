"""Connected components of a distributed edge list: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kardia.llm.common import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the smallest node reachable.

    Each round is joins and map-side combined minima; its edges are written to
    the shared scratch folder, so plans stay short and a lost executor costs no
    earlier round. Only the number and a checksum of the edges reach the driver.
    """
    state = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        sums = state.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (sums.n, sums.x) == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
        before = (sums.n, sums.x)
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = materialise(small.union(least).distinct(), "cc")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
