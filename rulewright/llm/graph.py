"""Connected components by alternating stars, each round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges(a, b)``: rows (node, component), the component's smallest node.

    Large-star hangs each node's larger neighbours on its smallest neighbour,
    small-star does the same for the smaller ones; both use minima that combine
    before the shuffle, and joins whose hot keys Spark splits.  Self loops and
    repeated edges are allowed; without edges the result is empty.  The result is
    stored; the caller drops it.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stored(pairs, "cc"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == before:
            out = stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()), "components")
            dropped(now)
            return out
        before = seen
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        after = stored(small.where("u <> v").distinct(), "cc")
        dropped(now)
        now = after
