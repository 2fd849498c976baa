"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words, and every document of it an emphasis.  Wanted
copies are in proportion to the emphasis, as far as no document gets more than
allowed.  The whole part of them is certain; for the fraction, its inclusion
probability, documents are ranked by random odds divided by inclusion odds and taken
in that order until the next one would pass the target.  The order is cut by counting
words in bins of the ranking value and ranking rows only inside the one bin where the
cut falls, so a source that holds most rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored

#: The most copies of one document, as a multiple of its source.
MOST = 3
#: Bins of the ranking value; a bin holds about this part of a source's rows.
BINS = 4096
#: Levels of all sources that may be broadcast, some 5 MB; with more the joins shuffle.
BROADCAST_LEVELS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Target words of each source: ``sizes(source, source_size)`` shared by weights 1, 2, 3, repeating.

    Sources count in code point order, null last.  A target stops at ``most``
    times its source's size and the excess is shared again by weight until none is
    above: with sources in the order of (limit / weight), the level that the open
    ones reach is the first one not above the next source's own limit.
    """
    w = sizes.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    w = w.withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))
    line = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    w = w.withColumn("spent", F.sum("limit").over(line) - F.col("limit"))
    w = w.withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(line) + F.col("weight"))
    w = w.withColumn("level", (F.sum("source_size").over(every) - F.col("spent")) / F.col("open"))
    w = w.withColumn("place", F.row_number().over(W.orderBy("ratio", F.col("source").asc_nulls_last())))
    w = w.withColumn("reached", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(every)["level"])
    return w.select("source", "source_size", "weight", F.least(F.col("limit").cast("double"), F.col("reached") * F.col("weight")).alias("target"))


def longer_first(size: Column) -> Column:
    """An emphasis that grows with the length of a text: 1 for an empty one, 5 for 65,536 words."""
    return 1 + F.log2(1 + size.cast("double")) / 4


def _levels(emphasis: Column) -> Column:
    """Emphasis in steps of an eighth of a doubling, so that a source has some hundreds of levels at most."""
    e = F.greatest(F.lit(2.0**-20), F.least(F.lit(2.0**20), F.coalesce(emphasis.cast("double"), F.lit(1.0))))
    return F.pow(F.lit(2.0), F.round(F.log2(e) * 8) / 8)


def wanted_copies(levels: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """Copies wanted of each document: ``levels(source, emphasis, words)`` and ``goals(source, target)``.

    They are the emphasis times a factor of the source, cut at ``most``, and the words
    of all copies come to the target.  With the greatest emphasis first, the factor
    that the levels not yet cut share is right once it leaves the next level uncut.
    """
    g = goals.select(F.col("source").alias("_g"), "target")
    both = levels.join(g, levels["source"].eqNullSafe(g["_g"])).drop("_g")
    down = W.partitionBy("source").orderBy(F.desc("emphasis"))
    up = down.rowsBetween(W.currentRow, W.unboundedFollowing)
    both = both.withColumn("cut", F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)))
    open_weight = F.sum(F.col("words") * F.col("emphasis")).over(up)
    both = both.withColumn("factor", F.when(open_weight > 0, (F.col("target") - most * F.coalesce("cut", F.lit(0))) / open_weight))
    fits = F.when(F.col("factor") * F.col("emphasis") <= most, F.struct((-F.col("emphasis")).alias("first"), "factor"))
    factor = F.min(fits).over(W.partitionBy("source"))["factor"]
    return both.select("source", "emphasis", "words", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(factor * F.col("emphasis"), F.lit(float(most))))).alias("wanted"))


def _uniform(seed: int) -> Column:
    """A number between 0 and 1 that follows from a row's id alone."""
    return (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def _order(u: Column, chance: Column) -> Column:
    """Random odds over inclusion odds, brought from [0, infinity) to [0, 1)."""
    q = (u / (1 - u)) * ((1 - chance) / chance)
    return q / (1 + q)


def mix_sources(documents: DataFrame, most: int = MOST, emphasis: Column | None = None, seed: int = 20, fit_last: bool = True) -> DataFrame:
    """``documents`` with size, source_size, target, wanted and copies: how often the mix takes each document.

    Needs ``doc_id``, ``source`` and ``text``; every other column is kept, and a
    column named like a result is replaced.  Size is the number of words (null
    text: 0).  ``emphasis`` is a column over ``documents`` and ``size``, by default
    ``longer_first``; null counts as 1.  ``wanted`` is the expected number of copies.
    Copies are its whole part or one more, and at most ``most``; a source's taken words
    differ from its target by less than a document.  ``fit_last`` gives the last place,
    outside the sampling, to the document left out that fits the words still open
    best.  Equal ids are taken alike.  A rerun gives the same mix.  An empty table
    gives an empty mix; a source without words is not taken.
    """
    results = ["size", "source_size", "target", "wanted", "copies"]
    base = documents.drop(*results)
    kept = base.columns
    weighed = base.withColumn("size", word_count(F.col("text")))
    weight = longer_first(F.col("size")) if emphasis is None else emphasis
    # The row's own columns travel in one, so that none of them clashes with what is computed.
    base = weighed.select(F.struct(*kept).alias("_row"), "doc_id", "source", "size", _levels(weight).alias("_e"), _uniform(seed).alias("_u"))
    rows = stored(base.drop("_row"), "mix")
    levels = rows.groupBy("source", F.col("_e").alias("emphasis")).agg(F.sum("size").alias("words"))
    sizes = levels.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = stored(targets(sizes, most), "goals")
    wanted = wanted_copies(levels, goals, most)
    # Rounding aside, a wanted number next to a whole one is that.
    whole = F.floor(F.col("wanted") + 1e-9)
    wanted = wanted.withColumn("whole", whole).withColumn("chance", F.greatest(F.lit(0.0), F.col("wanted") - whole))
    wanted = stored(wanted, "wanted")
    few = F.broadcast if wanted.count() <= BROADCAST_LEVELS else lambda df: df
    rest = wanted.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("whole") * F.col("words")).alias("sure"))
    goal = goals.join(rest, goals["source"].eqNullSafe(rest["_s"])).select(goals["source"].alias("goal_source"), "source_size", "target", F.greatest(F.lit(0.0), F.col("target") - F.col("sure")).alias("rest"))
    plan_rows = wanted.withColumnRenamed("source", "_ws").withColumnRenamed("emphasis", "_we").drop("words")

    def placed(df: DataFrame) -> DataFrame:
        df = df.join(few(goal), df["source"].eqNullSafe(goal["goal_source"])).join(few(plan_rows), F.col("source").eqNullSafe(F.col("_ws")) & (F.col("_e") == F.col("_we"))).drop("_ws", "_we")
        chance = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("chance")))
        return df.withColumn("order", F.when(F.col("chance") > 0, _order(F.col("_u"), chance))).withColumn("bin", F.floor(F.col("order") * BINS))

    at = placed(rows)
    sums = at.where("bin is not null").groupBy("goal_source", "bin", "rest").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("goal_source").orderBy("bin")) - F.col("words")
    # The bin in which the words taken come to the rest: the last one that begins before it.
    edge = sums.withColumn("before", before).where("before <= rest").groupBy("goal_source").agg(F.max_by(F.struct("bin", "before"), "bin").alias("edge"))
    edge = edge.select(F.col("goal_source").alias("edge_source"), F.col("edge.bin").alias("edge_bin"), "edge.before")
    inside = at.join(few(edge), at["goal_source"].eqNullSafe(edge["edge_source"]) & (at["bin"] == edge["edge_bin"]))
    inside = inside.groupBy("goal_source", "rest", "before", "order", "doc_id").agg(F.sum("size").alias("size"))
    reached = F.sum("size").over(W.partitionBy("goal_source").orderBy("order", "doc_id")) + F.col("before")
    own = F.struct("order", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
    cut = inside.withColumn("reached", reached).where("reached <= rest").groupBy("goal_source").agg(F.max(own).alias("cut"), F.max("reached").alias("reached"))
    plan = edge.join(cut, edge["edge_source"].eqNullSafe(cut["goal_source"]), "left")
    plan = stored(plan.select("edge_source", "edge_bin", "cut", F.coalesce("reached", "before").alias("reached")), "cuts")

    def chosen(df: DataFrame) -> Column:
        return F.coalesce((F.col("bin") < F.col("edge_bin")) | ((F.col("bin") == F.col("edge_bin")) & F.coalesce(own <= F.col("cut"), F.lit(False))), F.lit(False))

    extra = chosen(at)
    if fit_last:
        gap = F.col("rest") - F.col("reached")
        left = at.join(few(plan), at["goal_source"].eqNullSafe(plan["edge_source"]))
        left = left.where(~chosen(left) & (F.col("wanted") < most) & (F.abs(gap - F.col("size")) < gap))
        last = left.groupBy(F.col("goal_source").alias("last_source")).agg(F.min_by("doc_id", F.struct(F.abs(gap - F.col("size")), "order", "doc_id")).alias("last_id"))
        plan = stored(plan.join(last, plan["edge_source"].eqNullSafe(last["last_source"]), "left").drop("last_source"), "plan")
        extra = extra | F.coalesce(F.col("doc_id") == F.col("last_id"), F.lit(False))

    full = placed(base)
    full = full.join(few(plan), full["goal_source"].eqNullSafe(plan["edge_source"]), "left")
    copies = F.least(F.lit(most), F.col("whole") + F.coalesce(extra.cast("int"), F.lit(0))).cast("int")
    return full.select(*(F.col("_row").getField(c).alias(c) for c in kept), "size", "source_size", "target", "wanted", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))


def expanded(mix: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
