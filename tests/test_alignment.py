"""Ordered table differences against plain Python."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from rulewright.operators import alignment as A


def subsequence(a, b):
    """Length of a longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            best[j + 1], prev = (prev + 1 if x == y else max(best[j + 1], best[j])), best[j + 1]
    return best[-1]


def table(spark, rows):
    # Row numbers have holes, and rows lie in another order than theirs.
    numbered = [(3 * k + 7, v) for k, v in enumerate(rows)]
    random.Random(1).shuffle(numbered)
    return spark.createDataFrame(numbered, "row_no long, v string")


def replayed(ops, a, b):
    """Operations applied to ``a``; they must cover both tables without holes."""
    out, i, j = [], 0, 0
    for tag, i1, i2, j1, j2 in ops:
        assert (i1, j1) == (i, j)
        assert {"equal": i2 - i1 == j2 - j1 > 0, "insert": i1 == i2 and j1 < j2, "delete": i1 < i2 and j1 == j2, "replace": i1 < i2 and j1 < j2}[tag]
        out += a[i1:i2] if tag == "equal" else b[j1:j2]
        i, j = i2, j2
    assert (i, j) == (len(a), len(b))
    return out


def compared(spark, a, b, **limits):
    diff = A.OrderedDiff(table(spark, a), table(spark, b), **limits)
    ops = sorted(((r.tag, r.i1, r.i2, r.j1, r.j2) for r in diff.opcodes().collect()), key=lambda r: r[1:])
    hunks = sorted((r.i1, r.i2, r.j1, r.j2) for r in diff.hunks().collect())
    ratio = diff.similarity().first()
    diff.close()
    assert replayed(ops, a, b) == b
    assert ratio.matched == sum(i2 - i1 for tag, i1, i2, _, _ in ops if tag == "equal")
    assert ratio.ratio == pytest.approx(2 * ratio.matched / (len(a) + len(b)) if a or b else 1)
    # Grouping is that of the standard library for the same operations.
    s = difflib.SequenceMatcher()
    s.opcodes = ops
    wanted = [(g[0][1], g[-1][2], g[0][3], g[-1][4]) for g in s.get_grouped_opcodes(3) if any(o[0] != "equal" for o in g)]
    assert hunks == wanted
    return ops, ratio.matched


def edited(rng, a, alphabet):
    b = [v for v in a if rng.random() > 0.15]
    for _ in range(len(a) // 6):
        b.insert(rng.randrange(len(b) + 1), rng.choice(alphabet))
    return b


def test_small_tables_are_longest_common_subsequences(spark):
    rng = random.Random(3)
    a = [rng.choice("abcd") for _ in range(40)]
    b = edited(rng, a, "abcd")
    assert compared(spark, a, b)[1] == subsequence(a, b)


@pytest.mark.parametrize("a,b,ops", [
    ("", "", []),
    ("", "ab", [("insert", 0, 0, 0, 2)]),
    ("ab", "", [("delete", 0, 2, 0, 0)]),
    ("abc", "abc", [("equal", 0, 3, 0, 3)]),
    ("abcde", "abXde", [("equal", 0, 2, 0, 2), ("replace", 2, 3, 2, 3), ("equal", 3, 5, 3, 5)]),
])
def test_plain_cases(spark, a, b, ops):
    assert compared(spark, list(a), list(b))[0] == ops


@pytest.mark.parametrize("most_runs", [A.MOST_RUNS, 4])
def test_large_gaps_by_anchors(spark, most_runs):
    rng = random.Random(5)
    a = [f"u{k}" if rng.random() < 0.6 else rng.choice("xyz") for k in range(120)]
    b = edited(rng, a, "xyz")
    moved = b[10:30]
    b = b[:10] + b[30:70] + moved + b[70:]
    matched = compared(spark, a, b, cells=20, most_runs=most_runs)[1]
    assert 0.8 * subsequence(a, b) <= matched <= subsequence(a, b)


def test_unique_rows_give_the_longest_series(spark):
    rng = random.Random(6)
    a = [f"u{k}" for k in range(80)]
    b = a[:20] + a[50:60] + a[20:50] + rng.sample(a[60:], 20)
    assert compared(spark, a, b, cells=9)[1] == subsequence(a, b)


def test_repeated_rows_only(spark):
    # No content stands once: the k-th copies meet.
    a, b = list("aab" * 12), list("aab" * 9 + "b" * 5)
    matched = compared(spark, a, b, cells=6)[1]
    assert 0.7 * subsequence(a, b) <= matched <= subsequence(a, b)


def test_nulls_nan_and_columns(spark):
    schema = "row_no long, x double, y string, z long"
    a = spark.createDataFrame([(1, None, "1", 0), (2, float("nan"), None, 0), (3, 1.0, "q", 0)], schema)
    b = spark.createDataFrame([(1, 1.0, None, 9), (2, float("nan"), None, 9), (3, 1.0, "q", 9)], schema).withColumn("more", F.lit(1))
    diff = A.OrderedDiff(a, b, ignore=["z"])
    assert {(r.tag, r.i1, r.i2, r.j1, r.j2) for r in diff.opcodes().collect()} == {("replace", 0, 1, 0, 1), ("equal", 1, 3, 1, 3)}
    with pytest.raises(ValueError):
        A.OrderedDiff(a, b, fields=["x"], ignore=["y"])
    with pytest.raises(ValueError):
        A.OrderedDiff(a, b, fields=["row_no"])
