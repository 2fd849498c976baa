"""Selectors nested to any depth and in any order, compiled into a chain of as-of joins.

A rule set says which selector each of its levels is; a rule has a key for each level.
A level narrows the rules of a row to those under the key it chooses, so the choices
made so far are part of the next level's join key.  Rows are never joined with all
rules of their set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import version_key
from ..sources.scratch import stored
from .meeting import small
from .selection import NOT_FOUND, _nearest, _seconds, _size, classed_tuples, key_matches, parameter_tuples
from .steps import last_not_after, neighbours, span_join

LEVELS = "array<struct<class:string,par:string>>"
MATCH_KEY = "array<struct<par:string,pattern:string>>"


def _match_key(text):
    """``A=x,B=y|z`` as a match key."""
    pair = F.transform(F.split(text, ","), lambda t: F.struct(F.substring_index(t, "=", 1).alias("par"), F.substring(t, F.instr(t, "=") + 1, F.length(t)).alias("pattern")))
    return pair.cast(MATCH_KEY)


def _match(rows: DataFrame, rules: DataFrame, key: list[str], level: int, parameters: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows times the weights at which some rule fits, and the rules under (class, weight): rules of one weight count as one selector."""
    group = F.struct(*key).alias("_g")
    own = rules.withColumn("match_key", _match_key(F.col(f"_t{level}"))).withColumn("_g", group)
    keys = own.select(F.col("_g").alias("rmap"), "match_key")
    keyed = parameter_tuples(rows, parameters).withColumn("_g", group)
    classes = classed_tuples(keyed.select(F.col("_g").alias("rmap"), "tuple").distinct(), [keys], parameters)
    fit = key_matches(classes, keys, parameters).withColumnRenamed("rmap", "_g")
    choice, weight = F.struct("class", "weight").alias(f"_c{level}"), F.col("weight").alias(f"_w{level}")
    under = own.join(fit, ["_g", "match_key"]).select(*rules.columns, choice)
    weights = classes.withColumnRenamed("rmap", "_g").join(fit.select("_g", "class", "weight").distinct(), ["_g", "class"]).select("_g", "tuple", choice, weight)
    return keyed.join(small(weights), ["_g", "tuple"]).drop("_g", "tuple"), under


def _level(rows: DataFrame, rules: DataFrame, key: list[str], level: int, kind: str, par: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the choice ``_c<level>`` of one level among the rules under ``key``, and the rules with the same column."""
    text, choice = F.col(f"_t{level}"), f"_c{level}"
    if kind == "Match":
        return _match(rows, rules, key, level, sorted(par.split(",")))
    value = F.try_element_at("params", F.lit(par)) if par else None
    if kind in ("UseAfter", "ClosestTime"):
        rules = rules.withColumn(choice, text.try_cast("timestamp"))
        points = rules.select(*key, choice).where(F.col(choice).isNotNull()).distinct()
        if kind == "UseAfter":
            spans = neighbours(points.withColumnRenamed(choice, "at"), key, "at").select(*key, "low", "high", F.col("below.at").alias(choice)).where("low is not null")
            return span_join(rows, spans, key, "exptime", "inner"), rules
        return _nearest(rows, points.withColumn("time", F.col(choice)), key, "exptime", "time", _seconds, [choice]).where(F.col(choice).isNotNull()), rules
    if kind in ("GeometricallyNearest", "Bracket"):
        rules = rules.withColumn(choice, text.try_cast("double").cast("float").cast("double"))
        points = rules.select(*key, F.col(choice).alias("number")).where("number is not null").distinct()
        asked = rows.withColumn("_v", value.try_cast("double"))
        if kind == "GeometricallyNearest":
            found = _nearest(asked, points.withColumn(choice, F.col("number")), key, "_v", "number", _size, [choice])
            return found.where(F.col(choice).isNotNull()).drop("_v"), rules
        both = span_join(asked, neighbours(points, key, "number"), key, "_v", "inner")
        low = F.coalesce("below.at", "above.at")
        high = F.when(F.col("below.at") == F.col("_v"), F.col("below.at")).otherwise(F.coalesce("above.at", "below.at"))
        # Both ends go on as rows of their own and come together at the end.
        return both.select(*rows.columns, F.posexplode(F.array(low, high)).alias(f"_s{level}", choice)), rules
    if kind == "VersionAfter":
        rules = rules.withColumn(choice, version_key(text))
        points = rules.select(*key, choice).distinct()
        found = last_not_after(rows.withColumn("_v", version_key(value)), points, key, choice, F.col("_v"), F.col(choice), F.col(choice))
        return found.where(F.col(choice).isNotNull()).drop("_v"), rules
    raise ValueError(f"no selector {kind}")


def _literal(shape: list) -> Column:
    return F.array(*(F.struct(F.lit(x["class"]).alias("class"), F.lit(x["par"]).alias("par")) for x in shape)).cast(LEVELS)


def _reads(shape: list) -> tuple[list[str], bool]:
    """The parameters that the levels of a nesting read, and whether they look at the time."""
    return sorted({p for x in shape for p in x["par"].split(",") if p}), any(x["class"] in ("UseAfter", "ClosestTime") for x in shape)


def _questions(datasets: DataFrame, rules: DataFrame, shapes: list) -> tuple[DataFrame, DataFrame]:
    """Datasets with what their nesting reads (_values, _time), and the distinct questions with a number."""
    number, values, time = F.lit(None).cast("int"), F.lit(None).cast("array<string>"), F.lit(None)
    for n, shape in enumerate(shapes):
        names, timed = _reads(shape)
        mine = F.col("_shape") == n
        number = F.when(F.col("levels") == _literal(shape), n).otherwise(number)
        values = F.when(mine, F.array(*(F.try_element_at("params", F.lit(p)) for p in names)).cast("array<string>")).otherwise(values)
        time = F.when(mine, F.col("exptime") if timed else F.lit(None)).otherwise(time)
    sets = rules.select("rmap", number.alias("_shape")).distinct()
    asked = datasets.join(small(sets), "rmap", "left")
    asked = asked.select("dataset_id", "rmap", "_shape", values.alias("_values"), time.cast(datasets.schema["exptime"].dataType).alias("_time"))
    questions = asked.where("_shape is not null").select("rmap", "_shape", "_values", "_time").distinct()
    return asked, stored(questions.withColumn("_question", F.monotonically_increasing_id()), "questions")


def nested_selectors(datasets: DataFrame, rules: DataFrame) -> DataFrame:
    """(dataset_id, rmap, reference) of datasets(dataset_id, rmap, params, exptime) by nested rules.

    ``rules(rmap, levels array<struct<class, par>>, keys array<string>, reference)``: ``levels`` is the
    same for all rules of a set and names each level's selector from the outside in, Match
    (``par``: its parameters, comma-separated), UseAfter, ClosestTime, GeometricallyNearest, Bracket
    or VersionAfter (``par``: the parameter whose value counts); ``keys`` are the level's keys
    as texts (``A=x,B=y`` for Match).  Where a level finds nothing, the outermost Match
    levels fall through to the next weight; rules of equal weight count as one selector.
    Under a Bracket the result is both ends' references, comma-separated.  Of
    rules with equal keys the greatest name counts; a dataset that nothing fits gets the
    no-match text.  Every distinct nesting is one chain of joins; there may be a
    hundred of them.

    What the levels of a nesting do not read does not matter: distinct questions (rule set, values
    read, time if a level looks at it) go down the chain, and datasets meet the
    answers in one join.  ``datasets`` is read twice.
    """
    shapes = [r.levels for r in rules.select("levels").distinct().limit(101).collect()]
    if len(shapes) > 100:
        raise ValueError("more than 100 nestings")
    rules = rules.groupBy("rmap", "levels", "keys").agg(F.max("reference").alias("reference"))
    asked, questions = _questions(datasets, rules, shapes)
    ident = ["dataset_id", "rmap"]
    out = []
    for n, shape in enumerate(shapes):
        own = rules.where(F.col("levels") == _literal(shape))
        own = own.select("rmap", *(F.get("keys", F.lit(j)).alias(f"_t{j}") for j in range(len(shape))), "reference")
        params = F.map_from_arrays(F.array(*map(F.lit, _reads(shape)[0])).cast("array<string>"), "_values")
        rows = questions.where(F.col("_shape") == n).select(F.col("_question").alias("dataset_id"), "rmap", params.alias("params"), F.col("_time").alias("exptime"))
        key, marks, ends = ["rmap"], [], []
        for j, x in enumerate(shape):
            rows, own = _level(rows, own, key, j, x["class"], x["par"])
            rows, own = stored(rows, f"level-{j}"), stored(own, f"rules-{j}")
            key = [*key, f"_c{j}"]
            marks += [f"_w{j}"] if x["class"] == "Match" else []
            ends += [f"_s{j}"] if x["class"] == "Bracket" else []
        last = own.groupBy(*key).agg(F.max("reference").alias("reference"))
        found = rows.join(small(last), key).select(*ident, *marks, *ends, "reference")
        # Both ends of a bracket, outer ones first, then the greatest weights that found something.
        found = found.groupBy(*ident, *marks).agg(F.array_sort(F.collect_list(F.struct(*ends, "reference"))).alias("r"))
        whole = found.where(F.size("r") == 2 ** len(ends)).select(*ident, *marks, F.array_join(F.transform("r", lambda e: e["reference"]), ",").alias("reference"))
        order = F.struct(*marks) if marks else F.lit(0)
        out.append(whole.groupBy(*ident).agg(F.max_by("reference", order).alias("reference")))
    if not out:
        return datasets.select(*ident, F.lit(NOT_FOUND).alias("reference"))
    answers = reduce(DataFrame.unionByName, out).select(F.col("dataset_id").alias("_question"), "reference")
    answers = questions.join(answers, "_question").select(F.col("rmap").alias("_r"), F.col("_values").alias("_v"), F.col("_time").alias("_t"), "reference")
    same = (F.col("rmap") == F.col("_r")) & (F.col("_values") == F.col("_v")) & F.col("_time").eqNullSafe(F.col("_t"))
    found = asked.join(small(stored(answers, "answers")), same, "left")
    return found.select(*ident, F.coalesce("reference", F.lit(NOT_FOUND)).alias("reference"))
