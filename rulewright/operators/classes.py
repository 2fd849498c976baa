"""Values of a parameter that none of its patterns tells apart.

Patterns are taken apart into bounds of numbers, literal texts and tests of texts.
The bounds cut the parameter's axis into elementary segments, and a number finds its
segment by an as-of join; literal texts meet by equality, globs by what they begin
with.  What a value found is its class, so a continuous parameter has as many classes
as its patterns have bounds, not as many as its data have values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import BETWEEN, LOGICAL, RELATION, match_status
from ..sources.scratch import dropped, stored
from .steps import span_join

ATOM = "array<struct<kind:string,text:string>>"


def _atom(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def _term_atoms(term: Column) -> Column:
    """What of a value one term looks at: numbers below and from a bound on, a literal text, or a test."""
    bound = F.regexp_extract(term, RELATION, 2)
    low, high = F.regexp_extract(term, BETWEEN, 1), F.regexp_extract(term, BETWEEN, 2)
    branch = lambda x: F.when(F.trim(x).rlike(r"[*?\[]"), _atom("test", F.trim(x))).otherwise(_atom("text", F.trim(x)))
    return (
        F.when(term.rlike(r"^\{.*\}$"), F.array(_atom("text", F.substring(term, F.lit(2), F.length(term) - 2))))
        .when(term.rlike(r"^\(.*\)$"), F.array(_atom("test", term)))
        .when(bound != "", F.array(_atom("bound", bound)))
        .when(term.rlike(BETWEEN), F.array(_atom("bound", low), _atom("bound", high)))
        .otherwise(F.transform(F.split(term, r"\|"), branch))
        .cast(ATOM)
    )


def pattern_atoms(patterns: DataFrame) -> DataFrame:
    """Distinct (i, kind, text) of patterns(i, pattern): kind is bound, text or test."""
    inner = F.regexp_replace("pattern", r"(?i)^not\s+", "")
    left, word, right = (F.regexp_extract(inner, LOGICAL, k) for k in (1, 2, 3))
    rows = patterns.where("pattern not in ('N/A', '*')").select("i", inner.alias("inner"), left.alias("left"), word.alias("word"), right.alias("right"))
    terms = rows.select("i", F.explode(F.when(F.col("word") == "", F.array("inner")).otherwise(F.array("left", "right", F.concat(F.lit("{"), F.upper("inner"), F.lit("}"))))).alias("term"))
    return terms.select("i", F.inline(_term_atoms(F.col("term")))).distinct()


def _prefix(test: Column) -> Column:
    """The letters that every value of a test begins with."""
    return F.when(test.startswith("("), "").otherwise(F.regexp_extract(test, r"^([^*?\[]*)", 1))


def value_classes(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(i, value, class) of distinct values(i, value): ``class`` is the least of the values that all patterns(i, pattern) treat alike.

    Values are compared with bounds by an as-of join, with texts by equality and with
    globs by their literal beginning; regular expressions are tried on all values of their
    parameter, as nothing else can tell.
    """
    atoms = stored(pattern_atoms(patterns), "atoms")
    number = F.col("value").try_cast("double")
    bounds = atoms.where("kind = 'bound'").select("i", F.col("text").try_cast("double").alias("low")).where("low is not null").distinct()
    line = W.partitionBy("i").orderBy("low")
    spans = bounds.select("i", "low", F.lead("low").over(line).alias("high"), F.col("low").alias("bound"))
    rows = span_join(values.withColumn("number", number), spans, ["i"], "number")
    texts = atoms.where("kind = 'text'").select(F.col("i").alias("_i"), F.col("text").alias("_t")).union(patterns.select("i").distinct().select("i", F.explode(F.array(F.lit("N/A"), F.lit("*"))))).distinct()
    rows = rows.join(texts.withColumn("_own", F.lit(True)), (F.col("i") == F.col("_i")) & (F.col("value") == F.col("_t")), "left").drop("_i", "_t")
    tests = atoms.where("kind = 'test'").select("i", F.col("text").alias("test"), _prefix(F.col("text")).alias("prefix")).withColumn("l", F.length("prefix"))
    begun = values.join(tests.select("i", "l").distinct(), "i").where(F.length("value") >= F.col("l")).withColumn("prefix", F.substring("value", F.lit(1), F.col("l")))
    passed = begun.join(tests, ["i", "l", "prefix"]).where(match_status(F.col("value"), F.col("test")) == 1)
    passed = passed.groupBy("i", "value").agg(F.array_sort(F.collect_set("test")).alias("tests"))
    marks = ["bound", "at", "own", "tests"]
    rows = rows.join(passed, ["i", "value"], "left")
    # A number on a bound is neither below nor above it.
    rows = rows.select("i", "value", F.coalesce(F.col("bound").cast("string"), F.when(F.col("number").isNotNull(), "first").otherwise("none")).alias("bound"), F.coalesce(F.col("number") == F.col("bound"), F.lit(False)).alias("at"), F.when(F.col("_own"), F.col("value")).otherwise("").alias("own"), F.coalesce("tests", F.array().cast("array<string>")).alias("tests"))
    rows = stored(rows, "value-marks")
    least = rows.groupBy("i", *marks).agg(F.min("value").alias("class"))
    out = stored(rows.join(least, ["i", *marks]).select("i", "value", "class"), "classes")
    dropped(atoms, rows)
    return out


def class_fits(classes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kind, i, value, pattern, score) where a class value fits a pattern of its parameter: score 1 for a match, 0 for N/A.

    Plain or-lists meet their members by equality; what is left is bounded by the
    number of bounds and tests.
    """
    plain = ~F.col("pattern").rlike(r"(?i)^not\s|^[#({<>=]|^\s*[<>=]|[*?\[]|^between\s") & (F.col("pattern") != "N/A")
    special = F.col("value").isin("N/A", "*")
    lists = patterns.where(plain)
    members = lists.select("i", "pattern", F.explode(F.transform(F.split("pattern", r"\|"), lambda x: F.trim(x))).alias("value"))
    by_text = members.join(classes.where(~special), ["i", "value"]).select("i", "value", "pattern").distinct().withColumn("score", F.lit(1))
    rest = classes.join(patterns.where(~plain), "i").unionByName(classes.where(special).join(lists, "i"))
    # Out of a generator, so that the long expression stands in the plan once and not in the filter, too.
    status = rest.select("i", "value", "pattern", F.explode(F.array(match_status(F.col("value"), F.col("pattern")))).alias("score"))
    return by_text.unionByName(status.where("score >= 0")).select(F.lit("").alias("kind"), "i", "value", "pattern", "score")
