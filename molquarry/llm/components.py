"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id of links(a, b; any type that has an order) the smallest id reachable from it.

    Large-star: every neighbour larger than a node is linked to the smallest neighbour; small-star: every smaller
    neighbour is linked to the smallest. Both are one aggregation with a map-side part and one join; a hot node's
    links are spread by Spark's skew join. Rounds go on until the links no longer change (about the logarithm of their number).
    Each round is written to the shared folder. Self-links and null ends are ignored."""
    edges = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        found = written(small.where("u <> v").distinct(), "links")
        now = found.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s"), F.bit_xor(F.xxhash64("u", "v")).alias("t")).first()
        discard(edges)
        edges = found
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
