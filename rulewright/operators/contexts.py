"""Contexts as tables of mapping edges: closures, lineage, differences of trees, history."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import dropped, stored
from .reach import reachable

def _few(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Broadcast a side after a check of its size; beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def context_closure(edges: DataFrame, roots: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(root, depth, name) of everything below each root(root), by ``edges(parent, child)``, however deep.

    With ``catalog(name)``, files that no root reaches are added, with neither root nor depth.
    """
    starts = roots.select("root", F.col("root").alias("node"))
    found = reachable(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")), starts)
    out = found.where("depth > 0").select("root", F.col("depth").cast("int").alias("depth"), F.col("node").alias("name"))
    if catalog is None:
        return out
    orphans = catalog.select("name").distinct().join(found.select(F.col("node").alias("name")), "name", "left_anti")
    return out.unionByName(orphans.select(F.lit(None).cast("string").alias("root"), F.lit(None).cast("int").alias("depth"), "name"))


def context_references(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """References of each root: what has nothing below it."""
    inner = edges.select(F.col("parent").alias("name")).distinct()
    return context_closure(edges, roots).join(inner, "name", "left_anti").select("root", F.col("name").alias("reference"))


def added_references(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("reference").subtract(old.select("reference"))


def updated_files(history: DataFrame, files: DataFrame, first: str, last: str) -> DataFrame:
    """Files of any context after ``first`` up to ``last`` that ``first`` does not have."""
    span = history.where((F.col("context") > first) & (F.col("context") <= last)).select("context")
    now = files.join(_few(span), "context", "left_semi").select("name").distinct()
    return now.subtract(files.where(F.col("context") == first).select("name"))


def uses(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(name, user, depth): every mapping that uses a file, directly or through others, however many."""
    starts = files.select(F.col("name").alias("root"), F.col("name").alias("node"))
    found = reachable(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")), starts)
    return found.where("depth > 0").select(F.col("root").alias("name"), F.col("node").alias("user"), F.col("depth").cast("int").alias("depth"))


def match_paths(rules: DataFrame, references: DataFrame) -> DataFrame:
    """Key paths that lead to the references: parameters, date and reference as one text."""
    steps = F.array_join(F.transform("match_key", lambda k: F.concat(k["par"], F.lit("="), k["pattern"])), ",")
    return rules.join(_few(references.select("reference").distinct()), "reference", "left_semi").select("rmap", "reference", steps.alias("path"), "useafter", "match_key")


def filter_match_paths(paths: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Drop a path where a listed parameter exists and its or-list lacks the value."""

    def lacks(name: str, value: str):
        return F.exists("match_key", lambda k: (k["par"] == name) & ~F.array_contains(F.split(k["pattern"], r"\|"), value))

    out = paths
    for name, value in wanted.items():
        out = out.where(~lacks(name, value))
    return out


def minimum_exptime(paths: DataFrame) -> DataFrame:
    return paths.groupBy("reference").agg(F.min("useafter").alias("exptime"))


def unreferenced(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Catalogued files outside the chosen contexts."""
    return files.join(referenced.select(F.col("reference").alias("name")).distinct(), "name", "left_anti")


def missing_files(referenced: DataFrame, store: DataFrame) -> DataFrame:
    """Files that contexts name and the store lacks."""
    return referenced.select(F.col("reference").alias("name")).distinct().join(store.select("name").distinct(), "name", "left_anti")


def derivation_parents(headers: DataFrame, roots: list[str] = ("generated", "none", "")) -> DataFrame:
    """(name, parent, found) of rule sets that name a parent; root markers are skipped."""
    asked = headers.where(~F.lower("derived_from").isin(list(roots)) & F.col("derived_from").isNotNull()).select("name", F.col("derived_from").alias("parent"))
    known = headers.select(F.col("name").alias("parent"), F.lit(True).alias("found")).distinct()
    return asked.join(known, "parent", "left").select("name", "parent", F.coalesce("found", F.lit(False)).alias("found"))


def diff_contexts(old: DataFrame, new: DataFrame, old_root: str, new_root: str, expand: bool = False) -> DataFrame:
    """Differences (path, action, old_child, new_child) of two trees of edges(parent, key, child, sha), from the top downward.

    Children of one parent are compared by key; what has the same checksum is the same all
    the way down and is not opened, what was replaced is compared one level deeper.  Added and deleted
    children are opened only with ``expand``; then everything below them is added or
    deleted, too.  Every level is stored, so that no level is read twice.
    """
    at = old.sparkSession.createDataFrame([(old_root, new_root, "")], "_a string, _b string, path string")
    out: list[DataFrame] = []

    def children(edges: DataFrame, side: str, parents: DataFrame) -> DataFrame:
        own = edges.select(F.col("parent").alias(f"_{side}"), "key", F.col("child").alias(f"{side}_child"), F.col("sha").alias(f"{side}_sha"))
        return parents.join(own, f"_{side}").select(F.col("path").alias("above"), "key", f"{side}_child", f"{side}_sha")

    while True:
        both = children(old, "a", at).join(children(new, "b", at), ["above", "key"], "full_outer")
        path = F.when(F.col("above") == "", F.col("key")).otherwise(F.concat_ws("/", "above", "key"))
        action = F.when(F.col("a_child").isNull(), "added").when(F.col("b_child").isNull(), "deleted").otherwise("replaced")
        level = both.where(~F.col("a_sha").eqNullSafe(F.col("b_sha"))).select(path.alias("path"), action.alias("action"), F.col("a_child").alias("old_child"), F.col("b_child").alias("new_child"))
        level = stored(level, "tree-level")
        if level.isEmpty() and out:
            dropped(level)
            break
        out.append(level)
        deeper = level if expand else level.where("action = 'replaced'")
        at = deeper.select(F.col("old_child").alias("_a"), F.col("new_child").alias("_b"), "path")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def tree_paths(edges: DataFrame, root: str) -> DataFrame:
    """(path, child, sha) of everything below ``root`` by edges(parent, key, child, sha), however deep; every level is stored."""
    level = edges.where(F.col("parent") == root).select(F.col("key").alias("path"), "child", "sha")
    out: list[DataFrame] = []
    while True:
        level = stored(level, "tree-paths")
        out.append(level)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        own = edges.select(F.col("parent").alias("_p"), "key", F.col("child").alias("_c"), F.col("sha").alias("_s"))
        level = level.join(own, F.col("child") == F.col("_p")).select(F.concat("path", F.lit("/"), "key").alias("path"), F.col("_c").alias("child"), F.col("_s").alias("sha"))


def diff_whole_contexts(old: DataFrame, new: DataFrame, old_root: str, new_root: str) -> DataFrame:
    """``diff_contexts`` for trees whose checksums say nothing about what lies below: all paths of both are compared."""
    a = tree_paths(old, old_root).select("path", F.col("child").alias("old_child"), F.col("sha").alias("_a"))
    b = tree_paths(new, new_root).select("path", F.col("child").alias("new_child"), F.col("sha").alias("_b"))
    both = a.withColumn("_old", F.lit(True)).join(b.withColumn("_new", F.lit(True)), "path", "full_outer")
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("replaced")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", action.alias("action"), "old_child", "new_child")


def auto_cutoffs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per instrument the earliest use-after date of any reference that was added or deleted."""
    key = ["instrument", "reference"]
    a, b = old.where("useafter is not null"), new.where("useafter is not null")
    changed = b.join(a.select(*key).distinct(), key, "left_anti").unionByName(a.join(b.select(*key).distinct(), key, "left_anti"))
    return changed.groupBy("instrument").agg(F.min("useafter").alias("cutoff"))


def history_index(history: DataFrame, point: int | str) -> int | None:
    """The index that an endpoint names: an index, a date (the first change from then on) or a part of a context's name."""
    if isinstance(point, int):
        return point
    if re.match(r"^\d{4}-\d\d-\d\d", point):
        found = history.where(F.col("start_date") >= F.lit(point).cast("timestamp"))
    else:
        found = history.where(F.col("context").contains(point))
    return found.agg(F.min("idx")).first()[0]


def history_pairs(history: DataFrame, start: int | str | None = None, stop: int | str | None = None) -> DataFrame:
    """Consecutive (old, new) contexts between two endpoints; steps backward are skipped.  A history has a row per change.

    Endpoints are indices, dates or parts of context names; one that names nothing gives no pairs.
    """
    rows = history
    for point, later in ((start, True), (stop, False)):
        if point is not None:
            k = history_index(history, point)
            rows = rows.where(F.lit(False)) if k is None else rows.where(F.col("idx") >= k if later else F.col("idx") <= k)
    pairs = rows.select(F.col("idx"), F.col("context").alias("old_context"), F.lead("context").over(W.orderBy("idx")).alias("new_context"))
    return pairs.where("new_context > old_context")


def latest_contexts(history: DataFrame, n: int) -> DataFrame:
    return history.orderBy(F.desc("idx")).limit(n)


def contexts_between(history: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Contexts from ``first`` to ``last``, either end open."""
    out = history if first is None else history.where(F.col("context") >= first)
    return out if last is None else out.where(F.col("context") <= last)


def with_children(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """A new context: ``updates(parent, key, child, sha)`` take the place of children with the same key."""
    key = ["parent", "key"]
    b = updates.select(*key, F.col("child").alias("new_child"), F.col("sha").alias("new_sha"))
    both = edges.select(*key, "child", "sha").join(b, key, "full_outer")
    return both.select(*key, F.coalesce("new_child", "child").alias("child"), F.coalesce("new_sha", "sha").alias("sha"))


def catalog_totals(files: DataFrame, by: list[str]) -> DataFrame:
    """Number and total bytes of the files of each group."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def organize_files(files: DataFrame, by: list[str]) -> DataFrame:
    """Files beside the group they belong to and its size: a row per file, so that no group is gathered in one place."""
    sizes = files.groupBy(*by).agg(F.count("*").alias("n"))
    return files.select(*by, "name").join(sizes, by)


def min_level_per_type(levels: DataFrame) -> DataFrame:
    """``levels(level, types)`` turned round: each type with its smallest level."""
    return levels.select("level", F.explode("types").alias("filekind")).groupBy("filekind").agg(F.min("level").alias("level"))
