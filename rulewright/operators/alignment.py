"""Ordered comparison of two tables: which rows stay, and the edit operations and hunks between them.

Rows with the same content are matched so that their order is kept in both tables.  A *gap* is
what lies between two matched pairs; at first all rows are one gap.  In each round

* rows whose content only one side of their gap has are left out, as nothing can match them;
* a gap with at most ``cells`` pairs of rows gets a longest common subsequence, by dynamic programming in one task;
* in a larger gap the contents that stand once on either side are candidates (if there are none,
  the k-th copies of each content are).  Candidates that are neighbours on both sides form runs,
  and the heaviest increasing series of runs is matched.  More than ``most_runs`` runs of a gap
  are first parted at the heaviest one.

What is matched cuts the gaps for the next round.  Positions come from range partitions and their
sizes, so no table passes through one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import dropped, stored
from .meeting import small

#: Pairs of rows that one task compares by dynamic programming: four bytes each.
CELLS = 1_000_000
#: Runs that one task orders.
MOST_RUNS = 1_000_000
#: Rows that a run is laid out by at a time.
_STEP = 1 << 16


def running(df: DataFrame, order: list[str], value: Column, name: str, first: int = 0) -> DataFrame:
    """``df``, stored, with ``first`` and the sum of ``value`` over all rows up to this one; ``order`` must tell rows apart.

    Rows are dealt by ranges of ``order``; only the ranges' sums are put in order in one place, one row per range.
    """
    dealt = stored(df.withColumn("_v", value.cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum("_v").alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_v").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    total = (F.col("_before") + inside + first).alias(name)
    out = stored(dealt.join(F.broadcast(before), "_part").select(*df.columns, total), "running")
    dropped(dealt)
    return out


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, stored, with the place of every row from 0."""
    return running(df, order, F.lit(1), name, -1)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence; of several the one whose pairs lie furthest to the end."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (b == x)))
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def heaviest_increasing(s: list[int], weights: list[int]) -> list[int]:
    """Places of a series with increasing ``s`` (all different) of the greatest weight."""
    rank = {v: k + 1 for k, v in enumerate(sorted(s))}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(s) + 1)
    before = []
    for k, v in enumerate(s):
        top, at = (0, -1), rank[v] - 1
        while at:
            top = max(top, tree[at])
            at &= at - 1
        before.append(top[1])
        mine, at = (top[0] + weights[k], k), rank[v]
        while at <= len(s):
            tree[at] = max(tree[at], mine)
            at += at & -at
    top, at = (0, -1), len(s)
    while at:
        top = max(top, tree[at])
        at &= at - 1
    out, k = [], top[1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _locally(rows: DataFrame) -> DataFrame:
    """Pairs (i, j) of rows (gap, side, pos, content) of gaps small enough for one task each."""
    def run(gap: pd.DataFrame) -> pd.DataFrame:
        rows = gap.sort_values("pos")
        codes, _ = pd.factorize(rows["content"])
        left = (rows["side"] == 0).to_numpy()
        at = rows["pos"].to_numpy()
        pairs = common_subsequence(codes[left], codes[~left])
        return pd.DataFrame({"i": [at[left][i] for i, _ in pairs], "j": [at[~left][j] for _, j in pairs]}, dtype="int64")

    return rows.groupBy("gap").applyInPandas(run, "i long, j long")


def _candidates(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """Candidate pairs (gap, i, j) of large gaps, stored: contents that stand once on either side, else the k-th copies of each."""
    once = F.when((F.col("na") == 1) & (F.col("nb") == 1), 1).otherwise(0)
    plain = kinds.groupBy("gap").agg(F.max(once).alias("anchored"))
    single = kinds.where("na = 1 and nb = 1").select("gap", F.col("ia").alias("i"), F.col("jb").alias("j"))
    loose = rows.join(plain.where("anchored = 0").select("gap"), "gap", "left_semi")
    if loose.isEmpty():
        return stored(single, "candidates")
    ordered = _numbered(loose, ["gap", "content", "side", "pos"], "n")
    first = ordered.groupBy("gap", "content", "side").agg(F.min("n").alias("first"))
    copies = ordered.join(first, ["gap", "content", "side"]).withColumn("k", F.col("n") - F.col("first"))
    a, b = (copies.where(f"side = {s}").select("gap", "content", "k", F.col("pos").alias(p)) for s, p in ((0, "i"), (1, "j")))
    out = stored(single.unionByName(a.join(b, ["gap", "content", "k"]).select("gap", "i", "j")), "candidates")
    dropped(ordered)
    return out


def _ends(pairs: DataFrame, x: str, y: str, step: int) -> DataFrame:
    """Pairs without a neighbour ``step`` away in both columns."""
    near = pairs.select((F.col(x) - step).alias(x), (F.col(y) - step).alias(y))
    return pairs.join(near, [x, y], "left_anti")


def _series(runs: DataFrame, most_runs: int) -> DataFrame:
    """Of runs (gap, r, s, w), those of a heaviest increasing series per gap: (r, w)."""
    runs, found = stored(runs.withColumn("part", F.col("gap")), "runs"), []
    while True:
        large = runs.groupBy("part").agg(F.count("*").alias("n"), F.max_by(F.struct("r", "s", "w"), F.struct("w", F.xxhash64("r"))).alias("top")).where(F.col("n") > most_runs)
        large = stored(large.select("part", F.col("top.r").alias("r0"), F.col("top.s").alias("s0"), F.col("top.w").alias("w0")), "large")
        if large.isEmpty():
            break
        found.append(large)
        joined = runs.join(large, "part", "left")
        side = F.when(F.col("r0").isNull(), 0).when((F.col("r") < F.col("r0")) & (F.col("s") < F.col("s0")), 1).when((F.col("r") > F.col("r0")) & (F.col("s") > F.col("s0")), 2)
        parted = joined.withColumn("side", side).where("side is not null")
        parted = stored(parted.select("gap", "r", "s", "w", F.when(F.col("side") == 0, F.col("part")).otherwise(F.xxhash64("part", "r0", "side")).alias("part")), "runs")
        dropped(runs)
        runs = parted

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("r")
        return rows.iloc[heaviest_increasing(rows["s"].tolist(), rows["w"].tolist())][["r", "w"]]

    out = runs.select("part", "r", "s", "w").groupBy("part").applyInPandas(run, "r long, w long")
    out = stored(reduce(DataFrame.unionByName, (f.select(F.col("r0").alias("r"), F.col("w0").alias("w")) for f in found), out), "series")
    dropped(large, runs, *found)
    return out


def _anchored(rows: DataFrame, kinds: DataFrame, most_runs: int) -> DataFrame:
    """Pairs (i, j) matched in large gaps."""
    candidates = _candidates(rows, kinds)
    ranked = _numbered(candidates, ["i"], "r")
    pairs = _numbered(ranked, ["j"], "s")
    # Runs end with their gap: from one gap to the next, s moves by more than one.
    apart = pairs.withColumn("s", F.col("s") + F.col("gap"))
    starts, ends = (_numbered(_ends(apart, "r", "s", step), ["r"], "k") for step in (-1, 1))
    series = _series(starts.join(ends.select("k", F.col("r").alias("last")), "k").select("gap", "r", "s", (F.col("last") - F.col("r") + 1).alias("w")), most_runs)
    laid = series.select("r", F.col("w"), F.explode(F.sequence(F.lit(0), F.expr(f"(w - 1) div {_STEP}"))).alias("at"))
    laid = laid.repartition("r", "at").select(F.explode(F.sequence(F.col("r") + F.col("at") * _STEP, F.col("r") + F.least(F.col("w"), (F.col("at") + 1) * _STEP) - 1)).alias("r"))
    out = stored(pairs.join(laid, "r").select("i", "j"), "anchors")
    dropped(candidates, ranked, pairs, starts, ends, series)
    return out


def positions(table: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Rows, stored, as (pos, content): their place by ``order`` from 0, and a digest of the columns, null and NaN told apart."""
    content = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return _numbered(table.select(F.col(order).alias("_order"), content.alias("content")), ["_order"], "pos")


def matched_rows(a: DataFrame, b: DataFrame, cells: int = CELLS, most_runs: int = MOST_RUNS) -> DataFrame:
    """Positions (i, j) of rows (pos, content) that stay, ascending in both; in tables of at most ``cells`` pairs a longest common subsequence."""
    sides = [df.select(F.lit(k).alias("side"), "pos", "content", F.lit(0).cast("long").alias("gap")) for k, df in enumerate((a, b))]
    rows, found = stored(sides[0].unionAll(sides[1]), "rows"), []
    while True:
        of = [F.col("side") == k for k in (0, 1)]
        kinds = rows.groupBy("gap", "content").agg(F.count_if(of[0]).alias("na"), F.count_if(of[1]).alias("nb"), F.min(F.when(of[0], F.col("pos"))).alias("ia"), F.min(F.when(of[1], F.col("pos"))).alias("jb"))
        kinds = stored(kinds.where("na > 0 and nb > 0"), "kinds")
        gaps = kinds.groupBy("gap").agg(F.sum("na").alias("a"), F.sum("nb").alias("b"), F.min("ia").alias("i"), F.min("jb").alias("j"))
        gaps = stored(gaps.withColumn("size", F.when(F.least("a", "b") == 1, "one").when(F.col("a").cast("double") * F.col("b") <= cells, "small").otherwise("large")), "gaps")
        # A large gap holds far more than a thousand rows, so there are few of them.
        large = gaps.where("size = 'large'").select("gap")
        shared = rows.join(kinds.select("gap", "content"), ["gap", "content"], "left_semi")
        local = shared.join(small(large), "gap", "left_anti").join(gaps.where("size = 'small'").select("gap"), "gap", "left_semi")
        found.append(stored(gaps.where("size = 'one'").select("i", "j").unionAll(_locally(local)), "matches"))
        if large.isEmpty():
            dropped(rows, kinds, gaps)
            break
        rest = stored(shared.join(small(large), "gap", "left_semi").select("side", "pos", "content", "gap"), "rest")
        anchors = _anchored(rest, kinds.join(small(large), "gap", "left_semi"), most_runs)
        found.append(anchors)
        marks = anchors.select(F.lit(0).alias("side"), F.col("i").alias("pos")).unionAll(anchors.select(F.lit(1), "j"))
        left = rest.join(marks, ["side", "pos"], "left_anti").unionByName(marks, allowMissingColumns=True)
        counted = running(left, ["side", "pos"], F.when(F.col("content").isNull(), 1).otherwise(0), "n")
        cut = F.col("gap") + F.col("n") - F.col("side") * anchors.count()
        nxt = stored(counted.where("content is not null").select("side", "pos", "content", cut.alias("gap")), "rows")
        dropped(rows, kinds, gaps, rest, counted)
        rows = nxt
    out = stored(reduce(DataFrame.unionAll, found), "matched")
    dropped(*found)
    return out


def _blocks(matches: DataFrame, na: int, nb: int) -> DataFrame:
    """Runs of matched rows in order, (k, i1, i2, j1, j2), and an empty one at the end of both tables."""
    starts, ends = (_numbered(_ends(matches, "i", "j", step), ["i"], "k") for step in (-1, 1))
    first = starts.select("k", F.col("i").alias("i1"), F.col("j").alias("j1"))
    blocks = first.join(ends.select("k", (F.col("i") + 1).alias("i2"), (F.col("j") + 1).alias("j2")), "k").select("k", "i1", "i2", "j1", "j2")
    last = starts.agg(F.count("*").alias("k")).select("k", *(F.lit(n).cast("long").alias(c) for n, c in ((na, "i1"), (na, "i2"), (nb, "j1"), (nb, "j2"))))
    out = stored(blocks.unionByName(last), "blocks")
    dropped(starts, ends)
    return out


def _changes(blocks: DataFrame) -> DataFrame:
    """What lies before each block, with the lengths of the blocks around it."""
    before = blocks.select((F.col("k") + 1).alias("k"), F.col("i2").alias("a1"), F.col("j2").alias("b1"), (F.col("i2") - F.col("i1")).alias("before"))
    both = blocks.join(before, "k", "left").select("k", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("a1", "b1", "before")), F.col("i1").alias("a2"), F.col("j1").alias("b2"), (F.col("i2") - F.col("i1")).alias("after"))
    return both.where("a2 > a1 or b2 > b1")


class OrderedDiff:
    """An ordered comparison of tables ``a`` and ``b``, rows in the order of column ``order`` (which tells a table's rows apart).

    Compared are the common columns but ``order``: only ``fields``, or all without ``ignore``.
    Without common columns there is nothing to compare, which is an error.  Empty tables are
    compared as others are.  ``close`` deletes what is stored.
    """

    def __init__(self, a: DataFrame, b: DataFrame, order: str = "row_no", fields: list[str] | None = None, ignore: list[str] = (), cells: int = CELLS, most_runs: int = MOST_RUNS):
        if fields and ignore:
            raise ValueError("fields and ignore exclude each other")
        common = [c for c in a.columns if c in b.columns and c != order and c not in ignore and (not fields or c in fields)]
        if not common:
            raise ValueError("the tables have no columns to compare")
        self.rows = [positions(t, order, common) for t in (a, b)]
        self.na, self.nb = (t.count() for t in self.rows)
        self.matches = matched_rows(*self.rows, cells, most_runs)
        self.blocks = _blocks(self.matches, self.na, self.nb)

    def opcodes(self) -> DataFrame:
        """Operations (tag, i1, i2, j1, j2) that turn rows i1 to i2 of ``a`` into rows j1 to j2 of ``b``; ends are excluded, rows count from 0."""
        tag = F.when(F.col("a2") == F.col("a1"), "insert").when(F.col("b2") == F.col("b1"), "delete").otherwise("replace")
        changed = _changes(self.blocks).select(tag.alias("tag"), F.col("a1").alias("i1"), F.col("a2").alias("i2"), F.col("b1").alias("j1"), F.col("b2").alias("j2"))
        return self.blocks.where("i2 > i1").select(F.lit("equal").alias("tag"), "i1", "i2", "j1", "j2").unionByName(changed)

    def similarity(self) -> DataFrame:
        """One row (rows_a, rows_b, matched, ratio): twice the rows that stay by all rows; 1 for empty tables."""
        n, m, both = F.lit(self.na).cast("long"), F.lit(self.nb).cast("long"), self.na + self.nb
        return self.matches.agg(F.count("*").alias("matched")).select(n.alias("rows_a"), m.alias("rows_b"), "matched", (F.col("matched") * 2.0 / F.lit(both) if both else F.lit(1.0)).alias("ratio"))

    def hunks(self, context: int = 3) -> DataFrame:
        """Changes with up to ``context`` equal rows around them, near ones together: (i1, i2, j1, j2, removed, added)."""
        near = running(_changes(self.blocks), ["k"], F.when(F.col("before") > 2 * context, 1).otherwise(0), "hunk")
        lead, tail = F.least("before", F.lit(context)), F.least("after", F.lit(context))
        ends = [F.min(F.col("a1") - lead).alias("i1"), F.max(F.col("a2") + tail).alias("i2"), F.min(F.col("b1") - lead).alias("j1"), F.max(F.col("b2") + tail).alias("j2")]
        return near.groupBy("hunk").agg(*ends, F.sum(F.expr("a2 - a1")).alias("removed"), F.sum(F.expr("b2 - b1")).alias("added")).drop("hunk")

    def close(self) -> None:
        dropped(*self.rows, self.matches, self.blocks)
