"""What a graph's nodes reach, to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, stored

#: Steps that are taken one by one before steps are doubled: most graphs are shallow.
LEVELS = 5
#: Doubled steps may be this many times as many as the links; beyond it steps are taken one by one again.
WIDEST = 20


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, node, depth) of all nodes that links(a, b) reach from starts(root, node), the starts at depth 0; depth is the least.

    Shallow graphs are walked level by level.  If there is more, steps of 2, 4, 8, ... links
    are made by joining steps with themselves: what lies within 2 ** k links and one
    step of 2 ** k more is all within 2 ** (k + 1), so a chain of n nodes takes log n
    rounds.  Cycles end where nothing new is found.  Where a graph has too many long walks,
    single steps go on.  Every round is stored and the one before dropped; the result
    is stored.
    """
    links = stored(links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "links")
    most = WIDEST * max(1, links.count())
    seen = stored(starts.select("root", "node", F.lit(0).cast("long").alias("depth")).distinct(), "reached")
    front, level = seen, 0

    def after(rows: DataFrame, steps: DataFrame, far: int) -> DataFrame:
        ahead = rows.join(steps, rows["node"] == steps["a"]).select("root", F.col("b").alias("node"), (F.col("depth") + far).alias("depth"))
        return ahead.groupBy("root", "node").agg(F.min("depth").alias("depth"))

    jumps, far, wide = links, 1, False
    while True:
        single = level < LEVELS or wide
        if single:
            new = after(front, links, 1).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        else:
            new = after(seen if far > 1 else front, jumps, far).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        new = stored(new, "level")
        if new.isEmpty():
            dropped(new, links, *([jumps] if jumps is not links else []))
            return seen
        both = stored(seen.unionByName(new), "reached")
        dropped(seen)
        if front is not seen:
            dropped(front)
        seen, front, level = both, new, level + 1
        if not single:
            twice = jumps.withColumnRenamed("b", "m").join(jumps.select(F.col("a").alias("m"), "b"), "m").select("a", "b").where("a <> b").distinct()
            twice = stored(twice, "jumps")
            wide = twice.count() > most
            if jumps is not links:
                dropped(jumps)
            jumps, far = twice, far * 2
            # Jumps count from what is within the same number of links, so the walk so far is taken as their start.
