"""Connected components by alternating large-star and small-star steps, all as DataFrame shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sabermill.llm.shared import Scratch


def connected_components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that ``links`` (a long, b long) names; component is the smallest node reachable.

    Each step hangs a node's larger (then its smaller or equal) neighbours on the smallest one, so a hub's links
    are a star, never pairs; the minimum is taken map-side first and AQE splits the join of a hub. Each round is
    written to the shared folder, so a lost executor costs one round. Null ends and self links are ignored, repeats
    count once; without links the result is empty.
    """
    edges = scratch.write(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    was = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every link leads from a node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = scratch.write(small, "links")
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        same, was = now == was, now
        scratch.drop(edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
