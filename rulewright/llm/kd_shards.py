"""Sharding by a k-d tree: weighted medians along the widest metadata dimension.

The rows of one text form a group.  Groups are the points of the tree, their bytes
the weights.  A node that stands for some shards is cut where the part of its bytes
that the first half of them has room for lies below, along the dimension in which it
is widest, until every node is one shard.  A group of more than an eighth of a shard
would upset the medians: there are few of these, and each is put whole into the shard
with most room before the tree is grown; only if no shard can hold it, it is split.
All counting is grouped aggregation over the narrow table of groups; the driver sees
a row per node and per large group, and there are fewer than eight per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, stored

#: Levels of a dimension, and of the hash that breaks ties, when a cut is sought.
LEVELS = 256
#: Groups above this share of a shard are placed before the tree is grown.
LARGE = 1 / 8
#: How far a shard may exceed its share when a large group is placed.
SLACK = 1.02
#: Rows that are numbered in one task, about, and points of one node that are sorted in one task at most.
NUMBERED, EDGE = 50_000, 50_000
DIMENSIONS = ["source", "language", "length"]


def value_ranks(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a string column with their rank in code point order, ranked range by range."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = rows.select(F.col(column).alias("_v")).distinct().repartitionByRange(parts, "_v").withColumn("_p", F.spark_partition_id())
    values = stored(values, "values")
    counts = values.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_b"))
    own = F.row_number().over(W.partitionBy("_p").orderBy("_v"))
    return values.withColumn("_r", own).join(before, "_p").select("_v", (F.col("_b") + F.col("_r")).cast("double").alias("_rank"))


def text_metadata(documents: DataFrame) -> DataFrame:
    """Per row: id, size in bytes plus 16, CRC and hash of the text, and the tree's dimensions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"), named("source").alias("_source"), named("lang").alias("_lang"), F.log2(size.cast("double")).alias("length"))
    rows = stored(rows, "rows")
    for column, dimension in (("_source", "source"), ("_lang", "language")):
        ranks = stored(value_ranks(rows, column), "ranks").withColumnsRenamed({"_v": column, "_rank": dimension})
        rows = rows.join(F.broadcast(ranks) if ranks.count() <= 100_000 else ranks, column).drop(column)
    return rows


def placed_large(groups: list[tuple[float, tuple]], room: list[float]) -> tuple[dict, list[float]]:
    """Shards of the large groups that fit whole, greatest first, and the room that is left."""
    found, room = {}, list(room)
    slack = (SLACK - 1) * (max(room) if room else 0)
    for size, key in sorted(groups, reverse=True):
        best = max(range(len(room)), key=lambda k: (room[k], -k))
        if size <= room[best] + slack:
            found[key] = best
            room[best] = max(0.0, room[best] - size)
    return found, room


def kd_leaves(points: DataFrame, room: list[float]) -> DataFrame:
    """``points(bytes, tie, DIMENSIONS)`` with the column shard, so that shards get bytes in proportion to ``room``."""
    spark = points.sparkSession
    now = stored(points.withColumn("node", F.lit(0)).withColumn("k", F.lit(len(room))), "kd")
    scale = now.agg(*(F.greatest(F.max(d) - F.min(d), F.lit(1e-9)).alias(d) for d in DIMENSIONS)).first()
    order = F.shiftrightunsigned("tie", 1)
    while True:
        spread = [x for d in DIMENSIONS for x in (F.min(d).alias(f"{d}_low"), F.max(d).alias(f"{d}_high"))]
        nodes = now.where("k > 1").groupBy("node", "k").agg(F.sum("bytes").alias("bytes"), *spread).collect()
        if not nodes:
            return now.withColumnRenamed("node", "shard").drop("k")
        plan = []
        for r in nodes:
            wide = max(DIMENSIONS, key=lambda d: (r[f"{d}_high"] - r[f"{d}_low"]) / scale[d])
            all_room, below = sum(room[r.node : r.node + r.k]), sum(room[r.node : r.node + r.k // 2])
            share = below / all_room if all_room > 0 else (r.k // 2) / r.k
            plan.append((r.node, DIMENSIONS.index(wide), float(r[f"{wide}_low"]), float(max(r[f"{wide}_high"] - r[f"{wide}_low"], 1e-9)), r.k // 2, float(r.bytes) * share))
        cuts = F.broadcast(spark.createDataFrame(plan, "node int, dim int, low double, width double, below int, goal double"))
        value = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
        level = F.least(F.lit(LEVELS - 1), F.floor((value - F.col("low")) / F.col("width") * LEVELS)).cast("int")
        placed = now.join(cuts, "node", "left").withColumn("level", level).withColumn("order", order)
        edge = _edge(placed)
        inside = placed.join(edge, "node").where("level = edge_level and order >= edge_low and order <= edge_high")
        inside = inside.groupBy("node", "goal", "before", "edge_level", "edge_low", "order").agg(F.sum("bytes").alias("bytes"))
        reached = F.sum("bytes").over(W.partitionBy("node").orderBy("order")) + F.col("before")
        # Without an own row at or below the goal, all of the edge cell lies above.
        taken = F.max(F.when(F.col("reached") - F.col("bytes") / 2 <= F.col("goal"), F.col("order")))
        last = inside.withColumn("reached", reached).groupBy("node", "edge_level", "edge_low").agg(taken.alias("taken"))
        last = last.select("node", "edge_level", F.coalesce("taken", F.col("edge_low") - 1).alias("edge_order"))
        full = placed.join(F.broadcast(last), "node", "left")
        low = F.struct("level", "order") <= F.struct("edge_level", "edge_order")
        split = F.col("dim").isNotNull()
        after = full.select(*points.columns, F.when(split & ~low, F.col("node") + F.col("below")).otherwise(F.col("node")).alias("node"), F.when(~split, F.col("k")).when(low, F.col("below")).otherwise(F.col("k") - F.col("below")).alias("k"))
        after = stored(after, "kd")
        dropped(now)
        now = after


def _edge(placed: DataFrame) -> DataFrame:
    """Per node the cell of (level, leading bits of the order) in which the goal falls; cells get finer until one has few points."""
    bits, edge = 8, None
    while True:
        inside = placed.where("dim is not null")
        before = F.lit(0).cast("double")
        if edge is not None:
            inside = inside.join(edge, "node").where("level = edge_level and order >= edge_low and order <= edge_high")
            before = F.first("before")
        cell = F.shiftright("order", 63 - bits)
        cells = inside.groupBy("node", "goal", "level", cell.alias("cell")).agg(F.sum("bytes").cast("double").alias("bytes"), F.count("*").alias("n"), before.alias("start"))
        running = F.sum("bytes").over(W.partitionBy("node").orderBy("level", "cell")) - F.col("bytes") + F.col("start")
        found = cells.withColumn("before", running).where("before <= goal").groupBy("node").agg(F.max_by(F.struct("level", "cell", "before", "n"), F.struct("level", "cell")).alias("e"))
        rows = found.collect()  # one for each node
        width = (1 << (63 - bits)) - 1
        table = [(r.node, r.e.level, r.e.cell << (63 - bits), (r.e.cell << (63 - bits)) + width, float(r.e.before)) for r in rows]
        edge = F.broadcast(placed.sparkSession.createDataFrame(table, "node int, edge_level int, edge_low long, edge_high long, before double"))
        if bits >= 63 or all(r.e.n <= EDGE for r in rows):
            return edge
        bits = min(63, bits + 10)


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Every row of ``documents`` in one of ``shards`` shards of nearly equal bytes.

    Needs ``doc_id``, ``text``, ``source`` and ``lang``; other columns are ignored.
    Returns doc_id, size (UTF-8 bytes plus 16, null text: 16), text_crc32 (null
    text: that of the empty text), law (``bytes``), shard, slot (from 0 without gaps
    in each shard) and grown_shard (null: this law has no other shard count).
    Equal texts share a shard unless no shard can hold them, then they are split by
    id.  Rows with equal ids are separate rows.  An empty table gives an empty result;
    with few rows some shards stay empty.
    """
    meta = stored(text_metadata(documents), "meta")
    key = ["text_crc32", "tie", "size"]
    total = meta.agg(F.count("*"), F.sum("size")).first()
    share = (total[1] or 0) / shards
    limit = max(1.0, share * LARGE)
    # Fewer than shards / LARGE groups exceed the limit.
    large = meta.groupBy(*key).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit).collect()
    sizes = {tuple(r[k] for k in key): float(r.bytes) for r in large}
    whole, room = placed_large([(n, k) for k, n in sizes.items()], [share] * shards)
    plan = [(*k, whole.get(k), 1 if k in whole else int(-(-n // limit))) for k, n in sizes.items()]
    plan = F.broadcast(meta.sparkSession.createDataFrame(plan, "text_crc32 long, tie long, size long, own int, parts int"))
    rows = meta.join(plan, key, "left").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.coalesce("parts", F.lit(1)).cast("long")))
    sure = rows.where("own is not null").select("doc_id", "size", "text_crc32", F.col("own").alias("shard"))
    rows = rows.where("own is null")
    points = rows.groupBy(*key, "part").agg(F.sum("size").alias("bytes"), *(F.min(d).alias(d) for d in DIMENSIONS))
    # Parts of one group are apart in the order of ties.
    points = points.select(*(F.col(k).alias(f"p_{k}") for k in [*key, "part"]), "bytes", F.when(F.col("part") == 0, F.col("tie")).otherwise(F.xxhash64("tie", "part")).alias("tie"), *DIMENSIONS)
    leaves = kd_leaves(points, room)
    match = rows["part"] == leaves["p_part"]
    for k in key:
        match = match & (rows[k] == leaves[f"p_{k}"])
    placed = rows.join(leaves.select("p_part", *(f"p_{k}" for k in key), "shard"), match).select("doc_id", "size", "text_crc32", "shard")
    placed = stored(placed.union(sure), "placed")
    dropped(meta)

    bins = max(8, -(-total[0] // (shards * NUMBERED)))
    placed = placed.withColumn("bin", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(bins)))
    counts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bin", (F.sum("n").over(W.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("first"))
    number = F.row_number().over(W.partitionBy("shard", "bin").orderBy("doc_id", "size", "text_crc32")) - 1
    return placed.withColumn("number", number).join(first, ["shard", "bin"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
