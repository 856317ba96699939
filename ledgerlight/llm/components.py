"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import release, stored


def _stars(pairs: DataFrame) -> DataFrame:
    """Hang every larger neighbour, then every smaller one, on the smallest around it."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").select("u", "v", "m")
    return (
        small.select("u", F.col("m").alias("v"))
        .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for each node of ``links (u, v)``; the root is the smallest node it reaches.

    Large-star and small-star steps alternate until the edges stand still; the number of
    rounds grows with the logarithm of the size. Only one row of counts returns a round.
    """
    oriented = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = stored(oriented), None
    while True:
        before, edges = edges, stored(_stars(edges))
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
