"""Differences between rule sets, and their maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hooks import apply_hooks
from ..functions.normalize import condition_value, is_newer
from ..sources.scratch import stored
from .meeting import meet

#: Header fields whose changes are of no interest.
BORING = ["name", "derived_from", "sha1sum", "row_keys"]


def key_text(match_key: Column) -> Column:
    return F.array_join(F.transform(match_key, lambda k: F.concat(k["par"], F.lit("="), k["pattern"])), ",")


def diff_rules(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Per key with one ``reference`` on each side: added, deleted or replaced."""
    a = old.select(*key, F.col("reference").alias("old_value"))
    b = new.select(*key, F.col("reference").alias("new_value"))
    same = None
    left, right = a.alias("a"), b.alias("b")
    for k in key:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = c if same is None else same & c
    both = left.join(right, same, "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    action = F.when(F.col("old_value").isNull(), "add").when(F.col("new_value").isNull(), "delete").otherwise("replace")
    return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), action.alias("action"), "old_value", "new_value")


def diff_headers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Differences of (rmap, header map): one row per key added, deleted or replaced."""
    a, b = (df.select("rmap", F.explode("header").alias("key", "reference")) for df in (old, new))
    return diff_rules(a, b, ["rmap", "key"]).withColumn("action", F.concat("action", F.lit("_header")))


def remove_boring(diffs: DataFrame) -> DataFrame:
    return diffs.where(~F.col("key").isin(BORING))


def check_diffs(diffs: DataFrame) -> DataFrame:
    """Warnings: deletions, and replacements by an older file."""
    older = F.coalesce(is_newer(F.col("old_value"), F.col("new_value")), F.lit(False))
    warning = F.when(F.col("action") == "delete", "deletion").when((F.col("action") == "replace") & older, "reversion")
    return diffs.withColumn("warning", warning).where("warning is not null")


def affected_modes(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Differences per matching parameters, dates left aside."""
    return diffs.groupBy(*by).agg(F.count("*").alias("n_diffs"))


def affected_types(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("instrument").agg(F.array_join(F.array_sort(F.collect_set("filekind")), " ").alias("filekinds"))


def insert_references(rules: DataFrame, inserts: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rules after inserts: an equal key in normal form is replaced, others are added; of several inserts on one key the last wins and ``n_inserts`` tells."""
    conditioned = [condition_value(F.col(k)).alias(k) for k in key]
    last = inserts.select(*conditioned, "reference", order).groupBy(*key).agg(F.max_by("reference", order).alias("new_reference"), F.count("*").alias("n_inserts"))
    both = rules.select(*conditioned, F.col("reference").alias("old_reference")).join(last, key, "full_outer")
    action = F.when(F.col("new_reference").isNull(), "keep").when(F.col("old_reference").isNull(), "add").otherwise("replace")
    return both.select(*key, F.coalesce("new_reference", "old_reference").alias("reference"), action.alias("action"), F.coalesce("n_inserts", F.lit(0)).cast("long").alias("n_inserts"))


def insert_headers(rules: DataFrame, headers: DataFrame, filekind: str, key: list[str], order: str, extra: list[str] = ()) -> DataFrame:
    """``insert_references`` by the headers of new references, after the type's update hooks have rewritten them.

    ``headers`` has ``rmap`` (the instrument), the columns of ``key``, ``reference`` and ``order``.  A hook may return several
    rows for a header, as lookups may rewrite theirs in several ways; each becomes a rule.  Parameters in ``extra``,
    which only help to work out others, are N/A in rules whatever the header says.
    """
    rewritten = apply_hooks("update", filekind, headers)
    return insert_references(rules, rewritten.withColumns({e: F.lit("N/A") for e in extra}), key, order)


def delete_references(rules: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules without the references, references that no rule has)."""
    gone = references.select("reference").distinct()
    return rules.join(gone, "reference", "left_anti"), gone.join(rules.select("reference").distinct(), "reference", "left_anti")


def drop_parameter(rules: DataFrame, name: str) -> DataFrame:
    return rules.withColumn("match_key", F.filter("match_key", lambda k: k["par"] != name))


def duplicate_keys(rules: DataFrame, key: list[str]) -> DataFrame:
    return rules.groupBy(*key).agg(F.count("*").alias("n_rules")).where("n_rules > 1")


def covering_patterns(patterns: DataFrame) -> DataFrame:
    """Which pattern of a field covers another: rows (kind, i, value, pattern, score) where ``pattern`` covers ``value``.

    ``patterns(kind, i, pattern)`` are distinct.  ``*`` covers all, N/A is covered by all and covers
    ``*``, and an or-list covers each smaller one whose members it has.  Or-lists
    meet through an inverted index: a list looks only at those that hold its rarest
    member, and counts how many of its own members they have.  ``score`` is 1 where only ``value`` is
    N/A and -1 where only ``pattern`` is.
    """
    key = ["kind", "i"]
    same = patterns.select(*key, F.col("pattern").alias("value"), "pattern")
    star = patterns.where("pattern = '*'").join(patterns.select(*key, F.col("pattern").alias("value")), key).select(*key, "value", "pattern")
    open_ = patterns.where("pattern = 'N/A'").select(*key, F.col("pattern").alias("value")).join(patterns, key)
    reverse = patterns.where("pattern = 'N/A'").join(patterns.where("pattern = '*'").select(*key, F.col("pattern").alias("value")), key).select(*key, "value", "pattern")
    lists = patterns.where("pattern not in ('*', 'N/A')").withColumn("members", F.array_distinct(F.transform(F.split("pattern", r"\|"), lambda x: F.trim(x))))
    index = lists.select(*key, "pattern", "members", F.explode("members").alias("member"))
    often = index.groupBy(*key, "member").agg(F.count("*").alias("n"))
    rarest = index.join(often, [*key, "member"]).groupBy(*key, "pattern").agg(F.min_by("member", F.struct("n", "member")).alias("member"), F.first("members").alias("own"))
    found = rarest.withColumnRenamed("pattern", "value").join(index, [*key, "member"])
    held = found.where((F.size("members") > F.size("own")) & (F.size(F.array_intersect("members", "own")) == F.size("own"))).select(*key, "value", "pattern")
    out = same.unionByName(star).unionByName(open_).unionByName(reverse).unionByName(held).distinct()
    na = lambda c: (F.col(c) == "N/A").cast("int")
    return out.withColumn("score", na("value") - na("pattern"))


def ambiguous_rules(rules: DataFrame) -> DataFrame:
    """Pairs of different keys of a rule set of which one covers the other at equal weight: (rmap, covered, covering).

    ``rules(rmap, match_key)`` have one order of parameters.  A key covers another if each of its
    patterns covers the other's; weights are equal if as many fields are N/A only
    here as only there.  Keys walk down the trie of keys, so only pairs that agree
    field by field meet.
    """
    patterns = F.transform("match_key", lambda k: k["pattern"])
    keys = stored(rules.select(F.col("rmap").alias("group"), patterns.alias("key")).distinct(), "keys")
    size = keys.agg(F.max(F.size("key")).alias("n"), F.min(F.size("key")).alias("m")).first()
    if size.n != size.m:
        raise ValueError("keys of different lengths")
    covers = stored(covering_patterns(keys.select(F.lit("").alias("kind"), F.posexplode("key").alias("i", "pattern")).distinct()), "covers")
    tuples = keys.select(F.lit("").alias("kind"), "group", F.col("key").alias("tuple"))
    found = meet(tuples, keys, covers, size.n or 0).where((F.col("score") == 0) & (F.col("tuple") != F.col("key")))
    return found.select(F.col("group").alias("rmap"), F.col("tuple").alias("covered"), F.col("key").alias("covering"))


def check_modifications(diffs: DataFrame, expected: list[str]) -> DataFrame:
    """Counts per action, and whether the action was expected."""
    return diffs.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("old_value").alias("n_old"), F.countDistinct("new_value").alias("n_new")).withColumn("expected", F.col("action").isin(expected))


def apply_substitutions(rules: DataFrame, substitutions: DataFrame) -> DataFrame:
    """Rewrite (par, pattern) fields by substitutions(par, value, replacement array); a list becomes an or-pattern.

    ``rules(rule_id, par, pattern)`` is the exploded key.
    """
    subs = F.broadcast(substitutions.select("par", F.col("value").alias("pattern"), F.array_join("replacement", "|").alias("put")))  # a header's few substitutions
    return rules.join(subs, ["par", "pattern"], "left").select("rule_id", "par", F.coalesce("put", "pattern").alias("pattern"))


def values_in_use(fields: DataFrame) -> DataFrame:
    """Per (rmap, par): sorted distinct branches of the patterns; patterns of other kinds make it unchecked."""
    special = F.col("pattern").rlike(r"^([({#<>=]|between |not )")
    branches = fields.select("rmap", "par", special.alias("special"), F.explode(F.when(special, F.array(F.lit(None).cast("string"))).otherwise(F.transform(F.split("pattern", r"\|"), lambda x: F.trim(x)))).alias("value"))
    return branches.groupBy("rmap", "par").agg(F.array_join(F.array_sort(F.collect_set("value")), " ").alias("in_use"), F.max("special").alias("unchecked"))


def required_parameters(fields: DataFrame) -> DataFrame:
    return fields.groupBy("rmap").agg(F.array_join(F.array_sort(F.collect_set("par")), " ").alias("parameters"))


def latest_per_key(rules: DataFrame, key: list[str]) -> DataFrame:
    order = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("useafter"), F.desc("reference")))
    return rules.withColumn("o", order).where("o = 1").drop("o")
