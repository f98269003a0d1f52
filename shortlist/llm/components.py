"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shortlist.llm.common import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node it can reach.

    Alternates large-star and small-star rounds until the edges stop changing: each round is one
    grouped minimum (combined before its shuffle) and one equi-join, and edges only ever shrink
    towards stars. Each round's edges are written to the shared folder, which also cuts lineage.
    Null ends and loops are ignored; repeated edges count once. No edges: an empty result.
    """
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    now, state = cut_lineage(now), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        now = cut_lineage(small)
        # the edges as a set, in two half sums that cannot overflow
        seen = now.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))),
            F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 32)),
        ).first()
        if seen[0] == 0 or tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
