"""Rule patterns as data: one expression that compares any value with any pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: Column) -> Column:
    """An or-pattern of globs as one anchored regular expression."""
    escaped = F.regexp_replace(pattern, r"([.^$+(){}\\])", r"\\$1")
    branches = F.transform(F.split(escaped, r"\|"), lambda x: F.replace(F.replace(F.trim(x), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")))
    return F.concat(F.lit("^(?:"), F.array_join(F.filter(branches, lambda x: x != ""), "|"), F.lit(")$"))


def _relation(value: Column, op: Column, bound: Column) -> Column:
    v, b = value.try_cast("double"), bound.try_cast("double")
    return F.coalesce(F.when(op == "<", v < b).when(op == "<=", v <= b).when(op == ">", v > b).when(op == ">=", v >= b).when(op == "=", v == b), F.lit(False))


RELATION = r"^\s*(<=|>=|<|>|=)\s*(\S+)\s*$"
BETWEEN = r"(?i)^between\s+(\S+)\s+(\S+)$"
LOGICAL = r"(?i)^#\s*(.*?)\s+(and|or)\s+(.*?)\s*#$"


def _simple(value: Column, pattern: Column) -> Column:
    """Whether a value fits a pattern that is no logical combination."""
    op, bound = F.regexp_extract(pattern, RELATION, 1), F.regexp_extract(pattern, RELATION, 2)
    low, high = F.regexp_extract(pattern, BETWEEN, 1), F.regexp_extract(pattern, BETWEEN, 2)
    inside = _relation(value, F.lit(">="), low) & _relation(value, F.lit("<"), high)
    return (
        F.when(pattern.rlike(r"^\{.*\}$"), value == F.substring(pattern, F.lit(2), F.length(pattern) - 2))
        .when(pattern.rlike(r"^\(.*\)$"), F.rlike(value, F.concat(F.lit("^(?:"), pattern, F.lit(")"))))
        .when(op != "", _relation(value, op, bound))
        .when(pattern.rlike(BETWEEN), inside)
        .when(pattern.rlike(r"[*?|\[]"), F.rlike(value, glob_regex(pattern)))
        .otherwise(value == pattern)
    )


def match_status(value: Column, pattern: Column) -> Column:
    """1 match, 0 neither, -1 mismatch.

    A value N/A or a pattern N/A is neither; a value ``*`` matches every pattern.
    Patterns: literal, ``{literal}``, or-list with globs, ``(regex)`` (a prefix),
    relations, ``between a b``, ``# x and y #``, ``# x or y #``, and ``not`` before any.
    """
    negated = pattern.rlike(r"(?i)^not\s")
    inner = F.when(negated, F.regexp_replace(pattern, r"(?i)^not\s+", "")).otherwise(pattern)
    left, word, right = (F.regexp_extract(inner, LOGICAL, k) for k in (1, 2, 3))
    # One or two terms, so that the long comparison stands in the plan once.
    fit = F.transform(F.when(word == "", F.array(inner)).otherwise(F.array(left, right)), lambda term: F.coalesce(_simple(value, term), F.lit(False)))
    fits = F.when(F.lower(word) == "and", F.forall(fit, lambda x: x)).otherwise(F.exists(fit, lambda x: x)) | ((word != "") & (F.upper(inner) == value))
    status = F.when(value == "*", 1).when(F.coalesce(fits, F.lit(False)), 1).otherwise(-1)
    return F.when((value == "N/A") | (inner == "N/A"), 0).when(negated, -status).otherwise(status)
