"""Joins of tuples of values with tuples of patterns, field by field along a trie of the patterns.

Which patterns of a field a value fits is worked out on distinct values and patterns
beforehand.  A tuple then walks down the tree of the keys' beginnings: at each field
it goes on with the patterns its value fits, as long as some key begins like that.
Every step is an equi-join; tuples are never paired with all keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, stored

#: Fields after which the walk is stored, so that plans stay short.
STEP = 8
#: Pairs of values and patterns that may be broadcast.
BROADCAST_FITS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_FITS) -> DataFrame:
    """Broadcast a side after a check of its size; beyond it the join shuffles.

    Of a stored table Spark knows the size, so it is left to decide without a count.
    """
    if hasattr(df, "_stored_at"):
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def meet(tuples: DataFrame, keys: DataFrame, fits: DataFrame, size: int) -> DataFrame:
    """(kind, group, tuple, key, score) of the tuples(kind, group, tuple) and keys(group, key) that fit in every field.

    Tuples and keys are distinct.  ``tuple`` and ``key`` are arrays of ``size`` texts; ``fits(kind, i, value, pattern, score)``
    says what fits field i (from 0); ``score`` sums up along the fields.
    """
    front = tuples.select("kind", "group", "tuple").withColumn("key", F.array().cast("array<string>")).withColumn("score", F.lit(0))
    kept = None
    for i in range(size):
        own = fits.where(F.col("i") == i).select(F.col("kind").alias("_k"), F.col("value").alias("_v"), F.col("pattern").alias("_p"), F.col("score").alias("_s"))
        front = front.join(own, (F.col("kind") == F.col("_k")) & (F.get("tuple", F.lit(i)) == F.col("_v")))
        front = front.select("kind", "group", "tuple", F.concat("key", F.array("_p")).alias("key"), (F.col("score") + F.col("_s")).alias("score"))
        front = front.join(keys.select("group", F.slice("key", 1, i + 1).alias("key")), ["group", "key"], "left_semi")
        if i % STEP == STEP - 1 and i + 1 < size:
            front, old = stored(front, "walk"), kept
            kept = front
            if old is not None:
                dropped(old)
    return front
