"""Goldens of the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rulewright.functions import normalize as N
from rulewright.functions.expressions import BadExpression, names_in, translate
from rulewright.functions.patterns import match_status


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "want"),
    [("any", "*"), (" n/a ", "N/A"), ("Not applicable here", "N/A"), ("4294967295.0", "-1.0"), ("42", "42.0"), ("-17", "-17.0"), ("8.", "8.0"), ("blue", "BLUE"), ("FALSE", "F"), ("t", "T"), ("() none", "N/A"), ("3e20", "3e+20"), ("7654321.25", "7654321.25"), ("0.0025", "0.0025"), ("0.000004", "4e-06"), ("-2147483648", "N/A"), ("2031-02-03 04:05:06", "2031-02-03 04:05:06")],
)
def test_condition_value(spark, value, want):
    assert one(spark, N.condition_value(F.lit(value))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mar 04 2031 05:06:07 UT", dt.datetime(2031, 3, 4, 5, 6, 7)),
        ("Nov 30 2029 11:59PM", dt.datetime(2029, 11, 30, 23, 59)),
        ("02/29/2028 13:14:15", dt.datetime(2028, 2, 29, 13, 14, 15)),
        ("2030-10-11T12:13:14", dt.datetime(2030, 10, 11, 12, 13, 14)),
        ("10-11-2030 12:13", dt.datetime(2030, 10, 11, 12, 13)),
        ("20271231:235958", dt.datetime(2027, 12, 31, 23, 59, 58)),
        ("09/08/19", dt.datetime(2019, 8, 9)),
        ("Jun 05, 2026", dt.datetime(2026, 6, 5)),
        ("11:13 PM", None),
        ("next week", None),
        (None, None),
    ],
)
def test_parse_date(spark, text, want):
    assert one(spark, N.parse_date(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("value", "pattern", "want"),
    [("A", "A", 1), ("A", "B", -1), ("N/A", "B", 0), ("A", "N/A", 0), ("*", "B", 1), ("*", "not B", -1), ("AB", "A*|C", 1), ("C", "A*|C", 1), ("D", "A*|C", -1), ("ABC", "(AB)", 1), ("5.0", "<6", 1), ("x", "<6", -1), ("5.0", "between 5 6", 1), ("6.0", "between 5 6", -1), ("5.5", "# >5 and <6 #", 1), ("7", "# >5 and <6 #", -1), ("7", "# <5 or >6 #", 1), ("A", "not A", -1), ("B", "not A", 1), ("N/A", "not A", 0), ("UNDEFINED", "*", 1), ("A.B", "{A.B}", 1), ("AxB", "A.B|Q", -1)],
)
def test_match_status(spark, value, pattern, want):
    assert one(spark, match_status(F.lit(value), F.lit(pattern))) == want


def test_expressions(spark):
    p = F.create_map(F.lit("A"), F.lit("x"), F.lit("N"), F.lit("3.0"))
    assert one(spark, translate("A == 'x' and N >= 3", p))
    assert not one(spark, translate("A in ('y', 'z') or not (N < 4)", p))
    assert names_in("A == 'x' and is_defined('B') and N > 1") == ["A", "N"]
    for bad in ("__import__('os')", "A.b == 1", "lambda: 1", "A ==", "f(A)"):
        with pytest.raises(BadExpression):
            translate(bad, p)


CURRENT, FIRST, SECOND = "tel_cam_flat_{}.fits", "m{}sky01_flt.fits", "5{}sky01_flt.fits"
PARTS = ["n{}thru1_syn.fits", "8{}thru1_syn.fits"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (CURRENT.format("0012"), CURRENT.format("0009"), True),
        (CURRENT.format("0012"), CURRENT.format("110"), False),
        (CURRENT.format("0012"), CURRENT.format("0012"), False),
        (CURRENT.format("0300"), "tel_cam_flat_0002.json", False),
        ("tel_cam_flat_0002.yaml", "tel_cam_flat_0300.json", True),
        ("some/dir/" + CURRENT.format("2"), "another/" + CURRENT.format("1"), True),
        (CURRENT.format("0001"), FIRST.format("999"), True),
        (FIRST.format("999"), CURRENT.format("0001"), False),
        (SECOND.format("000"), FIRST.format("999"), True),
        (SECOND.format("120"), SECOND.format("119"), True),
        (FIRST.format("120"), FIRST.format("121"), False),
        (SECOND.format("000"), CURRENT.format("0001"), None),
        (PARTS[1].format("000"), PARTS[0].format("999"), True),
        (PARTS[0].format("010"), PARTS[0].format("009"), True),
        (PARTS[1].format("000"), SECOND.format("000"), None),
        (CURRENT.format("0001"), PARTS[0].format("000"), None),
        ("N/A", FIRST.format("000"), False),
        (PARTS[0].format("000"), "N/A", True),
        ("N/A", "N/A", False),
    ],
)
def test_is_newer(spark, a, b, want):
    assert one(spark, N.is_newer(F.lit(a), F.lit(b))) is want
