"""Which reference applies to each dataset: weighted matches, then a choice by date, version or distance.

Datasets are never crossed with rules.  The distinct parameter tuples of a rule
set are few, so they are matched with its rules; what fits a tuple becomes a step
function of time, and every dataset finds its step by an as-of join without being
multiplied and without carrying its tuple's list of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hooks import apply_hooks, hooked
from ..functions.normalize import UNDEFINED, version_key
from ..functions.patterns import match_status
from ..sources.scratch import dropped, stored
from .classes import class_fits, value_classes
from .meeting import meet, small
from .results import resolve_result
from .steps import last_not_after, neighbours, running_best, span_join
from .tables import decided_cases, raw_values

NOT_FOUND = "NOT FOUND No match found."
IRRELEVANT = "NOT FOUND n/a"
INVALID_DATE = "NOT FOUND invalid date"
def _patterned(rules: DataFrame, parameters: list[str]) -> DataFrame:
    """Distinct (rmap, match_key, patterns): a key's patterns in the order of the parameters, N/A where it has none."""

    def pattern(name: str) -> Column:
        return F.coalesce(F.get(F.filter("match_key", lambda k: k["par"] == name), F.lit(0))["pattern"], F.lit("N/A"))

    return rules.select("rmap", "match_key").distinct().withColumn("patterns", F.array(*map(pattern, parameters)))


def classed_tuples(tuples: DataFrame, rules: list[DataFrame], parameters: list[str]) -> DataFrame:
    """tuples(rmap, tuple) with ``class``: for each value one that no rule of any of ``rules`` tells from it.

    The result is stored; the caller drops it.
    """
    tuples = stored(tuples, "tuples")
    each = [_patterned(r, parameters).select(F.posexplode("patterns").alias("i", "pattern")) for r in rules]
    patterns = stored(reduce(DataFrame.union, each).distinct(), "patterns")
    classes = value_classes(tuples.select(F.posexplode("tuple").alias("i", "value")).distinct(), patterns)
    known, out = small(classes), tuples.withColumn("class", F.array().cast("array<string>"))
    for i in range(len(parameters)):
        own = known.where(F.col("i") == i).select(F.col("value").alias("_v"), F.col("class").alias("_c"))
        out = out.join(own, F.get("tuple", F.lit(i)) == F.col("_v")).withColumn("class", F.concat("class", F.array("_c"))).drop("_v", "_c")
    out = stored(out, "class-tuples")
    dropped(tuples, patterns, classes)
    return out


def key_matches(classes: DataFrame, rules: DataFrame, parameters: list[str]) -> DataFrame:
    """Distinct (rmap, class) and (rmap, match_key) that fit, with their weight.

    Statuses are worked out once for a class value and a pattern; class tuples then
    walk down the trie of the keys of their rule set.
    """
    keys = stored(_patterned(rules, parameters), "keys")
    asked = classes.select("rmap", "class").distinct()
    patterns = keys.select(F.posexplode("patterns").alias("i", "pattern")).distinct()
    fits = stored(class_fits(asked.select(F.posexplode("class").alias("i", "value")).distinct(), patterns), "fits")
    walk = asked.select(F.lit("").alias("kind"), F.col("rmap").alias("group"), F.col("class").alias("tuple"))
    met = meet(walk, keys.select(F.col("rmap").alias("group"), F.col("patterns").alias("key")), fits, len(parameters))
    met = met.select(F.col("group").alias("rmap"), F.col("tuple").alias("class"), F.col("key").alias("patterns"), F.col("score").alias("weight"))
    out = stored(met.join(keys, ["rmap", "patterns"]).select("rmap", "class", "match_key", "weight"), "key-matches")
    dropped(keys, fits)
    return out


def rule_parameters(rules: DataFrame) -> list[str]:
    """Names of the parameters that the rules match by: a few dozen."""
    names = [r.par for r in rules.select(F.explode("match_key.par").alias("par")).distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 matching parameters")
    return sorted(names)


def weighted_match(headers: DataFrame, rules: DataFrame, parameters: list[str] | None = None) -> DataFrame:
    """Headers(rmap, params map) joined with the rules(rmap, match_key array<struct<par, pattern>>, ...) they fit.

    A rule with a mismatch is out; ``weight`` counts its matches.  A missing
    parameter is the text UNDEFINED.  ``parameters`` are those of the rules.
    """
    names = parameters or rule_parameters(rules)
    keyed = parameter_tuples(headers, names)
    classes = classed_tuples(keyed.select("rmap", "tuple").distinct(), [rules], names)
    fit = key_matches(classes, rules, names)
    rows = keyed.join(small(classes), ["rmap", "tuple"])
    return rows.join(fit.join(rules, ["rmap", "match_key"]), ["rmap", "class"]).drop("tuple", "class")


def rank_candidates(matched: DataFrame, ident: str = "dataset_id") -> DataFrame:
    """Candidates of each dataset and rule set, best first: dense rank by weight."""
    return matched.withColumn("rank", F.dense_rank().over(W.partitionBy(ident, "rmap").orderBy(F.desc("weight"))))


def parameter_tuples(datasets: DataFrame, parameters: list[str]) -> DataFrame:
    """Datasets with the tuple of a rule set's parameters."""
    values = [F.coalesce(F.try_element_at("params", F.lit(p)), F.lit(UNDEFINED)) for p in parameters]
    return datasets.withColumn("tuple", F.array(*values))


def _tasks(rows: DataFrame) -> int:
    """Tasks for rows that are few before a join and many after it: a given number is not reduced for their size."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def class_candidates(classes: DataFrame, rules: DataFrame, parameters: list[str]) -> DataFrame:
    """Per distinct (rmap, class): the (weight, useafter, reference) of the rules that fit.

    Many rules of a set share a match key and differ in date, so classes are compared
    with distinct keys; the dates come by an equi-join.
    """
    fit = key_matches(classes, rules, parameters)
    dates = rules.groupBy("rmap", "match_key", "useafter").agg(F.max("reference").alias("reference")).repartition(_tasks(rules), "rmap", "useafter")
    # Of the rules of one weight and date the greatest name counts; those of a date are together, so what fits them is not shuffled.
    found = dates.join(small(fit), ["rmap", "match_key"]).groupBy("rmap", "class", "weight", "useafter").agg(F.max("reference").alias("reference"))
    found = stored(found, "candidates")
    dropped(fit)
    return found


def reference_steps(classes: DataFrame, rules: DataFrame, parameters: list[str]) -> DataFrame:
    """Per (rmap, class) the reference as a step function of exposure time: disjoint spans [low, high).

    A rule counts from its use-after date on (one without a date always).  In the
    order of dates a rule begins a step if no earlier one has a greater weight; so a
    group whose dates are all later falls through to the next weight.  One more row
    per class, marked ``unknown``, holds what an unknown exposure time gets.
    """
    found = class_candidates(classes, rules, parameters)
    key = ["rmap", "class"]
    steps = running_best(found, key, "useafter", ["weight"]).select(*key, "low", "high", "reference", F.lit(False).alias("unknown"))
    dateless = F.max_by("reference", F.struct("weight", "reference")).alias("reference")
    none = found.groupBy(*key).agg(F.max(F.col("useafter").isNotNull()).alias("dated"), dateless)
    none = none.select(*key, F.when(F.col("dated"), INVALID_DATE).otherwise(F.col("reference")).alias("reference"), F.lit(True).alias("unknown"))
    return steps.unionByName(none, allowMissingColumns=True)


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys with a number ``_no``, which rows carry in their place."""
    return stored(rows.select(*key).distinct().withColumn("_no", F.monotonically_increasing_id()), "numbers")


def best_reference(datasets: DataFrame, rules: DataFrame, parameters: list[str]) -> DataFrame:
    """``datasets(rmap, params, exptime, ...)`` with the reference that applies.

    Of the rules that fit and whose use-after date is not later than the exposure
    (a rule without one is always in time) the one with the greatest weight counts,
    then the latest date, then the greatest file name: a group whose dates are all
    later falls through to the next weight.  A miss is the no-match text; an unknown
    exposure time is an error text unless no rule of the tuple has a date.

    ``datasets`` is read twice; a row that has to move carries the number of its class.
    """
    keyed = parameter_tuples(datasets, parameters)
    classes = classed_tuples(keyed.select("rmap", "tuple").distinct(), [rules], parameters)
    steps = reference_steps(classes, rules, parameters)
    key = ["rmap", "class"]
    numbers = _numbered(classes, key)
    tuples = stored(classes.join(numbers, key).drop("class"), "numbered-tuples")
    both = span_join(keyed.join(tuples, ["rmap", "tuple"]).drop("tuple"), steps.join(numbers, key).drop(*key), ["_no"], "exptime")
    return both.withColumn("reference", F.coalesce("reference", F.lit(NOT_FOUND))).drop("_no")


def result_spans(classes: DataFrame, old: DataFrame, new: DataFrame, parameters: list[str]) -> DataFrame:
    """Both contexts' references per (rmap, class) as spans [low, high) of exposure time, with columns old and new.

    The step functions of the two contexts are laid over each other; a row marked
    ``unknown`` holds what an unknown time gets.
    """
    key, marks = ["rmap", "class"], []
    for side, rules in (("old", old), ("new", new)):
        steps = reference_steps(classes, rules, parameters)
        marks.append(steps.select(*key, "unknown", "low", F.col("reference").alias(side)))
    # Before its first step, and without any, a class has no match on that side.
    begin = classes.select(*key).distinct().select(*key, F.explode(F.array(F.lit(False), F.lit(True))).alias("unknown"), F.lit(NOT_FOUND).alias("old"), F.lit(NOT_FOUND).alias("new"))
    both = marks[0].unionByName(marks[1], allowMissingColumns=True).unionByName(begin, allowMissingColumns=True)
    both = both.groupBy(*key, "unknown", "low").agg(*(F.max_by(c, (F.col(c) != NOT_FOUND).cast("int")).alias(c) for c in ("old", "new")))
    line = W.partitionBy(*key, "unknown").orderBy(F.col("low").asc_nulls_first())
    so_far = line.rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.select(*key, "unknown", "low", F.lead("low").over(line).alias("high"), *(F.last(c, True).over(so_far).alias(c) for c in ("old", "new")))


def compared_references(datasets: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], parameters: list[str], include: list[str] | None = None, undefined_matters: bool = False, tables: tuple[DataFrame, DataFrame] | None = None, same: bool = False, killed: bool = False) -> DataFrame:
    """What a change of context does to datasets(dataset_id, instrument, params, exptime): all types at once.

    ``old`` and ``new`` are contexts as (serving(instrument, filekind, rmap), rules); a
    type that one of them lacks finds nothing there.  Rows are (dataset_id, instrument, filekind,
    old_reference, new_reference, kind): updates and errors; what stays the same is left
    out unless ``same``.  ``killed`` adds a column that says whether some type of the dataset failed.
    A failed lookup in the new context is an error whatever the old result.  ``tables`` is
    (rows, registry) of ``effective_updates``: updates whose tables select the same
    rows for the dataset have kind ``no effect``.

    Old and new results are compared per span of a distinct tuple, and table effects decided
    per (span, mode values), before a dataset is touched.  Spans of all types share the instrument's
    tuples, so a dataset meets them in one join and becomes as many rows as it has findings.
    """
    fields = [] if tables is None else _mode_names(tables[1])
    names = [*parameters, *(f for f in fields if f not in parameters)]
    wide = parameter_tuples(datasets, names).withColumnRenamed("tuple", "_wide")
    wides = stored(wide.select("instrument", "_wide").distinct(), "tuples")
    short = F.slice("_wide", 1, len(parameters)).alias("tuple")
    sides, slots = [], None
    slot = F.concat_ws("\x01", "instrument", "filekind")
    for serving, rules in (old, new):
        own = serving if include is None else serving.where(F.col("filekind").isin(include))
        own = own.select("instrument", "filekind", "rmap").distinct()
        slots = own if slots is None else slots.union(own)
        sides.append(rules.select("rmap", "match_key", "useafter", "reference").join(small(own), "rmap").withColumn("rmap", slot))
    slots = stored(slots.select("instrument", "filekind", slot.alias("rmap")).distinct(), "slots")
    # Classes serve all types of an instrument and both contexts.
    owned = [rules.withColumn("rmap", F.col("instrument")) for rules in sides]
    classes = classed_tuples(wides.select(F.col("instrument").alias("rmap"), short).distinct(), owned, parameters)
    per_slot = classes.select(F.col("rmap").alias("instrument"), "class").distinct().join(small(slots), "instrument").select("rmap", "class")
    spans = result_spans(per_slot, *sides, parameters)
    _, before = resolve_result(F.col("old"), undefined_matters)
    ok, after = resolve_result(F.col("new"), undefined_matters)
    kind = F.when(~ok, "error").when(before != after, "update").otherwise("same")
    spans = spans.select("rmap", "class", "unknown", "low", "high", before.alias("old_reference"), after.alias("new_reference"), kind.alias("kind"))
    spans = spans if same else spans.where("kind <> 'same'")
    spans = stored(spans.join(small(slots), "rmap").drop("rmap"), "findings")
    # A dataset's tuple leads to its class and, for tables, to its mode values.
    named = classes.withColumnRenamed("rmap", "instrument")
    wides = stored(wides.withColumn("tuple", short).join(named, ["instrument", "tuple"]).drop("tuple"), "tuple-classes")
    key = ["class"]
    if tables is not None:
        rows, registry = tables
        # Classes and mode values that occur together; other header values do not matter any more.
        modes = F.array(*(F.get("_wide", F.lit(names.index(f))) for f in fields)).cast("array<string>")
        wides = wides.withColumn("modes", modes)
        params = F.map_from_arrays(F.array(*map(F.lit, fields)), "modes")
        spans = wides.select("instrument", "class", "modes").distinct().join(spans, ["instrument", "class"])
        spans = stored(spans.withColumn("params", params), "mode-findings")
        case = ["instrument", "filekind", "old_reference", "new_reference", "raw"]
        equal = decided_cases(spans.where("kind = 'update'"), rows, registry)
        marked = spans.join(small(registry), ["instrument", "filekind"], "left").withColumn("raw", raw_values(F.col("fields"), F.col("params"))).drop("fields", "params")
        marked = marked.join(equal.withColumn("_same", F.lit(True)), case, "left")
        spans = marked.withColumn("kind", F.when(F.col("_same") & (F.col("kind") == "update"), "no effect").otherwise(F.col("kind"))).drop("_same", "raw")
        key = ["class", "modes"]
    out = ["filekind", "old_reference", "new_reference", "kind"]
    spans = spans.select("instrument", *key, "unknown", "low", "high", *out)
    if killed:
        spans, out = with_killed_spans(spans, ["instrument", *key]), [*out, "killed"]
    numbers = _numbered(wides, ["instrument", *key])
    wides = stored(wides.join(numbers, ["instrument", *key]).select("instrument", "_wide", "_no"), "numbered-tuples")
    spans = spans.join(numbers, ["instrument", *key]).drop("instrument", *key)
    rows = wide.join(wides, ["instrument", "_wide"]).select("dataset_id", "instrument", "exptime", "_no")
    return span_join(rows, spans, ["_no"], "exptime", "inner").select("dataset_id", "instrument", *out)


def with_killed_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """spans(key, unknown, low, high, filekind, kind, ...) cut where an error of any type of the key begins or ends, with ``killed``.

    Errors of all types are added up to a step function of time, which is laid over each
    type's spans: whether a dataset is killed is known before datasets are touched.
    """
    spans = stored(spans, "findings")
    place = [*key, "unknown"]
    edge = F.explode(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("d"), F.lit(False).alias("end")), F.struct(F.col("high").alias("at"), F.lit(-1).alias("d"), F.lit(True).alias("end")))).alias("e")
    edges = spans.where("kind = 'error'").select(*place, edge).where("not (e.end and e.at is null)")
    edges = edges.groupBy(*place, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    depth = F.sum("d").over(W.partitionBy(*place).orderBy(F.col("at").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow))
    failing = edges.select(*place, "at", (depth > 0).alias("killed"))
    failing = spans.select(*place, "filekind").distinct().join(failing, place)
    others = [c for c in spans.columns if c not in (*place, "filekind", "low")]
    begun = spans.select(*place, "filekind", F.col("low").alias("at"), F.struct(*others).alias("s"))
    line = [*place, "filekind"]
    both = begun.unionByName(failing, allowMissingColumns=True).groupBy(*line, "at").agg(F.max("s").alias("s"), F.max("killed").alias("killed"))
    order = W.partitionBy(*line).orderBy(F.col("at").asc_nulls_first())
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = both.select(*line, F.col("at").alias("low"), F.lead("at").over(order).alias("next"), F.last("s", True).over(so_far).alias("s"), F.coalesce(F.last("killed", True).over(so_far), F.lit(False)).alias("killed"))
    cut = cut.where(F.col("s").isNotNull() & F.coalesce(F.col("low") < F.col("s.high"), F.lit(True)))
    return cut.select(*line, "low", F.least("next", "s.high").alias("high"), *(F.col(f"s.{c}").alias(c) for c in others if c != "high"), "killed")


def _mode_names(registry: DataFrame) -> list[str]:
    """Mode fields of all types: a few dozen."""
    names = [r.n for r in registry.select(F.explode("fields.name").alias("n")).distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 mode fields")
    return sorted(names)


def ambiguous_matches(matched: DataFrame, ident: str = "dataset_id") -> DataFrame:
    """Datasets for which several rules of the top weight share a date (an error where overlaps are not merged)."""
    top = rank_candidates(matched, ident).where("rank = 1")
    return top.groupBy(ident, "rmap", "weight", "useafter").agg(F.count("*").alias("n_rules"), F.max("reference").alias("reference")).where("n_rules > 1")


def ambiguous_tuples(headers: DataFrame, rules: DataFrame, parameters: list[str]) -> DataFrame:
    """``ambiguous_matches`` of the distinct (rmap, tuple) of headers, without a row per tuple and rule.

    Rules are counted per key and date first, and keys added up per class; tuples meet only the result.
    """
    classes = classed_tuples(parameter_tuples(headers, parameters).select("rmap", "tuple").distinct(), [rules], parameters)
    fit = key_matches(classes, rules, parameters)
    dates = rules.groupBy("rmap", "match_key", "useafter").agg(F.count("*").alias("n"), F.max("reference").alias("reference"))
    key = ["rmap", "class"]
    # Every weight that fits has a rule, so the top one is known before dates come in.
    top = fit.groupBy(*key).agg(F.max("weight").alias("weight"))
    best = stored(fit.join(top, [*key, "weight"]), "top-matches")
    found = dates.repartition(_tasks(rules), "rmap", "useafter").join(small(best), ["rmap", "match_key"])
    found = found.groupBy(*key, "weight", "useafter").agg(F.sum("n").alias("n_rules"), F.max("reference").alias("reference")).where("n_rules > 1")
    return classes.join(found, key).select("rmap", "tuple", "weight", "useafter", "n_rules", "reference")


def equal_weight_choices(matched: DataFrame, ident: str = "dataset_id") -> DataFrame:
    """All choices of the top weight where terminals carry no date, sorted and joined."""
    top = rank_candidates(matched.where("useafter is null"), ident).where("rank = 1")
    return top.groupBy(ident, "rmap").agg(F.array_join(F.array_sort(F.collect_set("reference")), ",").alias("choices"))


def validity_intervals(rules: DataFrame, key: list[str]) -> DataFrame:
    """``rules(useafter, reference)`` as [useafter, next_useafter) per key; of one date the greatest name counts."""
    one = rules.groupBy(*key, "useafter").agg(F.max("reference").alias("reference"))
    return one.withColumn("next_useafter", F.lead("useafter").over(W.partitionBy(*key).orderBy("useafter")))


def useafter_asof(datasets: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """As-of join through validity intervals: for long lists of dates per key."""
    spans = validity_intervals(rules, key).withColumn("low", F.col("useafter")).withColumnRenamed("next_useafter", "high")
    return span_join(datasets, spans, key, "exptime").withColumn("reference", F.coalesce("reference", F.lit(NOT_FOUND)))


def version_after(datasets: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """Greatest rule version (a struct) not above the dataset's ``version``."""
    points = rules.groupBy(*key, "version").agg(F.max("reference").alias("reference"))
    found = last_not_after(datasets, points, key, "_f", F.col("version"), F.col("version"), F.struct("version", "reference"))
    return found.withColumn("reference", F.coalesce(F.col("_f.reference"), F.lit(NOT_FOUND))).drop("_f")


def _nearest(datasets: DataFrame, rules: DataFrame, key: list[str], at: str, point: str, distance: Callable[[Column, Column], Column], keep: list[str]) -> DataFrame:
    """``datasets`` with the ``keep`` columns of the point of their key at the smallest distance, of equal ones the first.

    Either neighbour of the value can be the nearest.  Distances are 32-bit, so points
    further below can be as near: where the second one is, the row is compared with
    all points of its key below the value, one aggregation.
    """
    points = rules.groupBy(*key, point).agg(F.min(F.struct(*keep)).alias("_kept"))
    both = span_join(datasets, neighbours(points, key, point), key, at)
    far = lambda c: distance(F.col(f"{c}.at"), F.col(at))
    lower = F.col("below").isNotNull() & (F.col("above").isNull() | (far("below") <= far("above")))
    both = both.withColumn("_d", F.when(lower, far("below"))).withColumn("_found", F.when(lower, F.col("below._kept")).otherwise(F.col("above._kept")))
    tied = F.coalesce(F.col("_d") == far("second"), F.lit(False))
    both = stored(both.withColumn("_tied", tied).drop("below", "above", "second"), "nearest")
    few = both.where("_tied").select(*key, F.col(at), "_d").distinct()
    all_points = points.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(point).alias("_p"), "_kept")
    same = reduce(and_, (F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)))
    first = few.join(all_points, same & (F.col("_p") <= F.col(at))).where(distance(F.col("_p"), F.col(at)) == F.col("_d"))
    first = first.groupBy(*key, F.col(at)).agg(F.min_by("_kept", "_p").alias("_first"))
    out = both.join(first, [*key, at], "left").withColumn("_found", F.coalesce("_first", "_found"))
    return out.select(*datasets.columns, *(F.col(f"_found.{c}").alias(c) for c in keep))


def _seconds(a: Column, b: Column) -> Column:
    return (F.abs(F.unix_micros(a.cast("timestamp")).cast("double") - F.unix_micros(b.cast("timestamp")).cast("double")) / 1e6).cast("float")


def _size(a: Column, b: Column) -> Column:
    return F.abs(a.cast("float") - b.cast("float"))


def closest_time(datasets: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """Smallest time difference in 32-bit seconds; of equal ones the earliest key."""
    found = _nearest(datasets, rules, key, "exptime", "time", _seconds, ["reference"])
    return found.withColumn("reference", F.coalesce("reference", F.lit(NOT_FOUND)))


def geometrically_nearest(datasets: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """Smallest distance of 32-bit numbers; of equal ones the smallest key."""
    found = _nearest(datasets, rules, key, "value", "number", _size, ["reference"])
    return found.withColumn("reference", F.coalesce("reference", F.lit(NOT_FOUND)))


def bracket(datasets: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """References of the largest key not above and the smallest not below ``value``; outside, the edge twice."""
    points = rules.groupBy(*key, "number").agg(F.max("reference").alias("most"), F.min("reference").alias("least"))
    both = span_join(datasets, neighbours(points, key, "number"), key, "value")
    above = F.when(F.col("below.at") == F.col("value"), F.col("below")).otherwise(F.col("above"))
    both = both.withColumn("above", above)
    low, high = F.coalesce("below.most", "above.least"), F.coalesce("above.least", "below.most")
    return both.withColumn("low_reference", low).withColumn("high_reference", high).drop("below", "above", "second")


def select_version(datasets: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """First relation in order that the dataset's ``version`` meets: ``<x`` before ``=x`` at one bound, default last.

    A version meets ``=x`` only at its own bound, which comes before every ``<x`` above
    it; of those the smallest bound counts.
    """
    one = lambda op: rules.where(F.col("op") == op)
    exact = one("=").groupBy(*key, F.col("bound").alias("version")).agg(F.min("reference").alias("_exact"))
    default = one("default").groupBy(*key).agg(F.min_by("reference", F.struct("bound", "reference")).alias("_default"))
    asked = datasets.select(*key, "version").distinct()
    below = one("<").groupBy(*key, F.col("bound").alias("version")).agg(F.min("reference").alias("_r"))
    both = asked.withColumn("_asked", F.lit(True)).unionByName(below.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    # Backward through the versions of a key, each asked one before the bounds that equal it: the last bound passed is the smallest above.
    line = W.partitionBy(*key).orderBy(F.desc("version"), F.desc("_asked")).rowsBetween(W.unboundedPreceding, W.currentRow)
    above = both.withColumn("_above", F.last("_r", True).over(line)).where("_asked").select(*key, "version", "_above")
    answers = above.join(exact, [*key, "version"], "left").join(default, key, "left")
    answers = answers.select(*key, "version", F.coalesce("_exact", "_above", "_default").alias("reference"))
    return datasets.join(answers, [*key, "version"], "left").withColumn("reference", F.coalesce("reference", F.lit(NOT_FOUND)))


def nested_select(datasets: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """Nearest number, then closest time, then version: each level narrows the rows of the one before.

    Every level is an as-of join whose key holds the choices of the levels before.
    """
    own = rules.withColumn("number", F.col("number").cast("float")).withColumn("_n", F.col("number")).withColumn("_t", F.col("time"))
    near = _nearest(datasets, own, key, "value", "number", _size, ["_n"])
    close = _nearest(near, own, [*key, "_n"], "exptime", "time", _seconds, ["_t"])
    return version_after(close, own, [*key, "_n", "_t"]).drop("_n", "_t")


def lookup_outcome(primary: Column, fallback: Column | None = None, relevant: Column | None = None, omitted: Column | None = None, required: Column | None = None, exempt: Column | None = None) -> Column:
    """Full outcome of one type; null where the type is omitted.

    Irrelevant types are naturally absent; a miss tries the fallback's result, is
    N/A for exempt headers and natural where the type is not required.
    """
    missed = primary.startswith("NOT FOUND")
    found = primary if fallback is None else F.when(missed & ~fallback.startswith("NOT FOUND"), fallback).otherwise(primary)
    still = found.startswith("NOT FOUND")
    out = F.when(found.isin("N/A", "TEMP_N/A"), "N/A").otherwise(found)
    if required is not None:
        out = F.when(still & ~required, IRRELEVANT).otherwise(out)
    if exempt is not None:
        out = F.when(still & exempt, "N/A").otherwise(out)
    if relevant is not None:
        out = F.when(~F.coalesce(relevant, F.lit(True)), IRRELEVANT).otherwise(out)
    gone = (found == "OMIT") if omitted is None else F.coalesce(omitted, F.lit(False)) | (found == "OMIT")
    return F.when(~gone, out)


def do_not_reprocess(reference: Column, params: Column, exempt: list[dict[str, list[str]]]) -> Column:
    """A failed lookup becomes N/A where the header has one of the listed combinations of values.

    Each combination is {parameter: allowed values}; all its parameters must agree.
    """
    listed = F.lit(False)
    for combination in exempt:
        agree = F.lit(True)
        for name, values in combination.items():
            agree = agree & F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(UNDEFINED)).isin(values)
        listed = listed | agree
    return F.when(reference.startswith("NOT FOUND") & listed, "N/A").otherwise(reference)


def best_references(datasets: DataFrame, context_rmaps: DataFrame, rules: DataFrame, parameters: list[str], include: list[str] | None = None) -> DataFrame:
    """References of all types of each dataset's instrument, or of the listed ones: (dataset_id, instrument, filekind, reference).

    ``context_rmaps(instrument, filekind, rmap)`` says which rule set serves a type.
    A dataset becomes one row per type, which is the size of the result; a rule set
    that lacks a parameter takes any value for it.
    """
    kinds = context_rmaps if include is None else context_rmaps.where(F.col("filekind").isin(include))
    rows = datasets.join(small(kinds), "instrument")
    return best_reference(rows, rules, parameters).select("dataset_id", "instrument", "filekind", "reference")


def best_references_by_date(datasets: DataFrame, history: DataFrame, at: str, contexts: DataFrame, rules: DataFrame, parameters: list[str], include: list[str] | None = None) -> DataFrame:
    """``best_references`` by the context that was active at a time; ``contexts(context, instrument, filekind, rmap)``."""
    active = active_context(history, at)
    return best_references(datasets, contexts.where(F.col("context") == F.lit(active)).drop("context"), rules, parameters, include)


def hooked_lookup(headers: DataFrame, rules: DataFrame, parameters: list[str], filekind: str) -> DataFrame:
    """``headers(dataset_id, rmap, params, exptime)`` with the reference of one type after its hooks.

    Headers are rewritten by the precondition hooks; what misses is rewritten by the
    fallback hooks of its instrument and looked up once more.
    """
    first = stored(best_reference(apply_hooks("precondition", filekind, headers), rules, parameters), "first")
    names = hooked("fallback", filekind)
    miss = F.coalesce(F.col("reference").startswith("NOT FOUND") & F.col("rmap").isin(names), F.lit(False))
    again = best_reference(apply_hooks("fallback", filekind, first.where(miss).drop("reference")), rules, parameters)
    # Only what missed is joined.
    second = first.where(miss).join(again.select("dataset_id", F.col("reference").alias("second")), "dataset_id", "left")
    out = second.unionByName(first.where(~miss), allowMissingColumns=True)
    return out.withColumn("reference", lookup_outcome(F.col("reference"), F.coalesce("second", "reference"))).drop("second")


def applicable_types(datasets: DataFrame, patterns: DataFrame, steps: DataFrame, types: DataFrame) -> DataFrame:
    """Types that a dataset's pipelines need: ``exp_type`` to pipeline by the first fitting glob, to steps, to types."""
    kinds = datasets.select("exp_type").distinct()
    first = kinds.join(small(patterns), match_status(F.col("exp_type"), F.col("pattern")) == 1).groupBy("exp_type").agg(F.min_by("pipeline", "ordinal").alias("pipeline"))
    need = first.join(small(steps), "pipeline").join(small(types), "step").select("exp_type", "filekind").distinct()
    return datasets.join(small(need), "exp_type")


def with_config(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """``datasets(cal_ver, ...)`` with the config of the latest ``versions(first_version, config)`` not above it, or the earliest one."""
    rows = datasets.withColumn("_v", version_key(F.col("cal_ver")))
    points = versions.select(version_key(F.col("first_version")).alias("_p"), "config").withColumn("_all", F.lit(1))
    found = last_not_after(rows.withColumn("_all", F.lit(1)), points, ["_all"], "_c", F.col("_v"), F.col("_p"), F.struct("_p", "config"))
    least = points.agg(F.min_by("config", "_p")).first()[0]
    return found.select(*datasets.columns, F.coalesce(F.col("_c.config"), F.lit(least)).alias("config"))


def replaced_pipeline(pipeline: Column, exceptions: list, value: Callable[[str, str], Column]) -> Column:
    """A pipeline after a config's exceptions, in their order.

    An exception names a parameter, patterns of values that keep the pipeline
    (``dont_replace``) or change it (``do_replace``), and what takes whose place.
    """
    out = pipeline
    for e in exceptions:
        v = value(e.param, e.default_missing or UNDEFINED)

        def fits(pattern: str, v: Column = v) -> Column:
            return v.rlike(f"^(?:{pattern})$")

        def put(c: Column, e=e) -> Column:
            return reduce(lambda o, kv: F.when(c == kv[0], kv[1]).otherwise(o), (e.replacements or {}).items(), c)

        changed = out
        if e.dont_replace:
            changed = F.when(~reduce(lambda x, y: x | y, map(fits, e.dont_replace)), put(changed)).otherwise(changed)
        for pattern in e.do_replace or []:
            changed = F.when(fits(pattern), put(changed)).otherwise(changed)
        out = F.when(F.col("config") == e.config, changed).otherwise(out)
    return out


def types_by_config(datasets: DataFrame, versions: DataFrame, patterns: DataFrame, exceptions: DataFrame, steps: DataFrame, types: DataFrame, step_exceptions: DataFrame) -> DataFrame:
    """Types that datasets(dataset_id, exp_type, cal_ver, params) need by the config of their calibration version.

    Of ``patterns(config, level, ordinal, pattern, pipeline)`` the first that fits the
    exposure type counts on each level; ``exceptions(config, param, default_missing,
    dont_replace, do_replace, replacements)`` put other pipelines in place;
    ``steps(config, pipeline, step)`` and ``types(config, step, filekind)`` lead to the
    types, but for steps with ``step_exceptions(config, step, ordinal, pattern,
    filekinds)``, of which the first that fits counts.  Config tables have a few hundred
    rows; each distinct combination of what they read is worked out once.
    """
    listed = exceptions.orderBy("config", "param").limit(1001).collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 pipeline exceptions")
    names = sorted({e.param for e in listed})
    read = [F.try_element_at("params", F.lit(n.upper())).alias(f"_x_{n}") for n in names]
    keyed = with_config(datasets, versions).select("dataset_id", "exp_type", "config", *read)
    kinds = stored(keyed.drop("dataset_id").distinct(), "kinds")
    marks = ["exp_type", "config", *(f"_x_{n}" for n in names)]
    fits = match_status(F.col("exp_type"), F.col("pattern")) == 1
    levels = kinds.join(patterns, "config").where(fits).groupBy(*marks, "level").agg(F.min_by("pipeline", "ordinal").alias("pipeline"))
    value = lambda name, default: F.coalesce(F.col(f"_x_{name}"), F.lit(default))
    levels = levels.withColumn("pipeline", replaced_pipeline(F.col("pipeline"), listed, value))
    need = levels.join(steps, ["config", "pipeline"]).select(*marks, "step").distinct()
    special = step_exceptions.select("config", "step").distinct()
    plain = need.join(special, ["config", "step"], "left_anti").join(types, ["config", "step"]).select(*marks, "filekind")
    first = need.join(step_exceptions, ["config", "step"]).where(fits).groupBy(*marks, "step").agg(F.min_by("filekinds", "ordinal").alias("f"))
    out = stored(plain.union(first.select(*marks, F.explode("f").alias("filekind"))).distinct(), "need")
    same = reduce(and_, (keyed[m].eqNullSafe(out[m]) for m in marks))
    return keyed.join(small(out), same).select(keyed["dataset_id"], keyed["exp_type"], keyed["config"], "filekind")


def selected_types(applicable: DataFrame, changed: DataFrame | None = None, asked: list[str] | None = None, skipped: list[str] = ()) -> DataFrame:
    """Types to process: those changed between contexts, or those asked for, or all that apply; never the skipped ones."""
    out = applicable
    if changed is not None:
        out = out.join(changed.select("instrument", "filekind").distinct(), ["instrument", "filekind"], "left_semi")
    elif asked:
        out = out.where(F.col("filekind").isin(list(asked)))
    return out.where(~F.col("filekind").isin(list(skipped))) if skipped else out


def old_references(datasets: DataFrame, kinds: DataFrame, natural_to_na: bool = True) -> DataFrame:
    """Recorded references: by the type's keyword, else by its name, else UNDEFINED."""
    both = datasets.join(small(kinds), "instrument")
    found = F.coalesce(F.try_element_at("params", F.col("keyword")), F.try_element_at("params", F.upper("filekind")), F.lit(UNDEFINED))
    if natural_to_na:
        found = F.when(F.upper(found) == "NOT FOUND N/A", "N/A").otherwise(found)
    return both.select("dataset_id", "instrument", "filekind", found.alias("reference"))


def bad_references(updates: DataFrame, bad: DataFrame) -> DataFrame:
    """Updates whose new reference is known to be bad."""
    listed = small(bad.select(F.lower("name").alias("bad_name")).distinct())
    return updates.withColumn("bad_name", F.lower("new_reference")).join(listed, "bad_name", "left_semi").drop("bad_name")


def bad_context_files(closure: DataFrame, bad: DataFrame) -> DataFrame:
    """(root, name) of closure(root, name) whose rule files or references are known to be bad, letters aside."""
    listed = small(bad.select(F.lower("name").alias("_bad")).distinct())
    return closure.join(listed, F.lower("name") == F.col("_bad"), "left_semi").select("root", "name")


def active_context(history: DataFrame, at: str) -> str | None:
    """The context that was active at a time: the latest start not after it, None before the first."""
    row = history.where(F.col("start_date") <= F.lit(at).cast("timestamp")).agg(F.max_by("context", F.struct("start_date", "idx")).alias("c")).first()
    return row.c if row else None
