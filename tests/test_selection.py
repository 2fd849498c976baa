"""Selection, comparison and hooks on small tables, against plain Python."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rulewright.functions.hooks import apply_hooks, hook
from rulewright.functions.patterns import match_status
from rulewright.operators import reprocess as R
from rulewright.operators import selection as S
from rulewright.operators import tables as T
from rulewright.operators.classes import value_classes
from rulewright.operators.meeting import meet
from rulewright.operators.steps import span_join

DAY = dt.datetime(2030, 1, 1)
RULE = "rmap string, match_key array<struct<par:string,pattern:string>>, useafter timestamp, reference string"
HEADER = "dataset_id string, rmap string, params map<string,string>, exptime timestamp"


def day(k):
    return None if k is None else DAY + dt.timedelta(days=k)


# What differs, by kind of the old and the new result, where undefined results do not matter and where they do (fixed values).
CHANGED = {
    False: {"defined": ["na", "undefined", "omitted"], "na": ["defined"], "undefined": ["defined"], "omitted": ["defined"], "error": ["defined", "na", "undefined", "omitted"]},
    True: {"defined": ["na"], "na": ["defined"], "undefined": ["defined", "na"], "omitted": ["defined", "na"], "error": ["defined", "na"]},
}
RAW = {"defined": "Some_File.fits", "na": "not found n/a", "undefined": "UNDEFINED", "omitted": None, "error": "NOT FOUND disk full"}


@pytest.mark.parametrize("undefined_matters", [False, True])
def test_comparison_of_all_kinds(spark, undefined_matters):
    rows = {side: [] for side in ("old", "new")}
    for a, b in itertools.product(RAW, RAW):
        for side, kind in (("old", a), ("new", b)):
            if kind != "omitted":
                rows[side].append((f"{a}>{b}", "cam", "flat", RAW[kind]))
    shape = "dataset_id string, instrument string, filekind string, reference string"
    out = R.compare_references(spark.createDataFrame(rows["old"], shape), spark.createDataFrame(rows["new"], shape), undefined_matters)
    got = {r.dataset_id: r for r in out.collect()}
    for a, b in itertools.product(RAW, RAW):
        r = got.get(f"{a}>{b}")
        if (a, b) == ("omitted", "omitted"):
            assert r is None
            continue
        failed = b == "error" or undefined_matters and b in ("undefined", "omitted")
        assert r.kind == ("error" if failed else "update" if b in CHANGED[undefined_matters][a] else "same"), (a, b, r)
        if r.kind == "update":
            nothing = "UNDEFINED" if undefined_matters else "N/A"
            assert r.old_reference == {"defined": "some_file.fits", "na": "N/A", "undefined": nothing, "omitted": nothing, "error": "NOT FOUND DISK FULL"}[a]
            assert r.new_reference == {"defined": "some_file.fits"}.get(b, "N/A")
    assert {r.dataset_id for r in R.regression_differences(out).collect()} == {k for k, r in got.items() if r.kind == "update" and "N/A" not in (r.old_reference, r.new_reference)}
    assert R.regression_differences(out, na_matters=True).count() == sum(r.kind == "update" for r in got.values())


def fits(value, pattern):
    if "N/A" in (value, pattern):
        return 0
    if value == "*":
        return 1
    return 1 if value in pattern.split("|") or pattern == "*" else -1


def best(rules, h):
    found = []
    for r in (r for r in rules if r[0] == h[1]):
        status = [fits(h[2].get(p, "UNDEFINED"), x) for p, x in r[1]]
        if -1 not in status:
            found.append((sum(status), r[2], r[3]))
    if h[3] is None:
        if any(u is not None for _, u, _ in found):
            return S.INVALID_DATE
        return max(found, key=lambda x: (x[0], x[2]))[2] if found else S.NOT_FOUND
    ready = [(w, u is not None, u or DAY, r) for w, u, r in found if u is None or u <= h[3]]
    return max(ready)[3] if ready else S.NOT_FOUND


@pytest.fixture(scope="module")
def world():
    rng = random.Random(12)
    rules = []
    for k in range(400):
        key = [("A", rng.choice(["x", "y", "x|y", "N/A", "*"])), ("B", rng.choice(["1", "2", "1|3", "N/A"]))]
        rules.append((rng.choice(["r", "s"]), key, day(rng.choice([None, *range(0, 60, 3)])), f"f{k:04d}"))
    heads = [(f"d{k}", rng.choice(["r", "s", "none"]), {p: rng.choice(v) for p, v in (("A", "xyz*"), ("B", "123")) if rng.random() < 0.9} | ({"A": "N/A"} if rng.random() < 0.1 else {}), day(rng.choice([None, *range(-3, 70)]))) for k in range(600)]
    return rules, heads


def test_best_reference_against_brute_force(spark, world):
    rules, heads = world
    out = S.best_reference(spark.createDataFrame(heads, HEADER), spark.createDataFrame(rules, RULE), ["A", "B"]).collect()
    assert {r.dataset_id: r.reference for r in out} == {h[0]: best(rules, h) for h in heads} and len(out) == len(heads)


def resolved(reference):
    """(ok, reference) of a raw result."""
    if reference in ("N/A", S.NOT_FOUND):
        return True, "N/A"
    return (False, reference.upper()) if reference.startswith("NOT FOUND") else (True, reference.lower())


@pytest.mark.parametrize("with_tables", [False, True])
def test_compared_references_against_brute_force(spark, world, with_tables):
    """Two types, one of which the new context lacks for one instrument; null times, failed lookups, kills and table effects."""
    rules, heads = world
    new = [(r[0], r[1], r[2], r[3] + ("n" if k % 5 == 0 else "")) for k, r in enumerate(rules) if k % 7]
    serving_old = [("cam", "flat", "r"), ("cam", "dark", "s"), ("spec", "dark", "s")]
    serving_new = [("cam", "dark", "s"), ("spec", "dark", "s"), ("spec", "flat", "r")]
    rows = [(h[0], "cam" if k % 2 else "spec", h[2] | {"M": "mnp"[k % 3]}, h[3]) for k, h in enumerate(heads)]
    serve = lambda x: spark.createDataFrame(x, "instrument string, filekind string, rmap string")
    df = spark.createDataFrame(rows, "dataset_id string, instrument string, params map<string,string>, exptime timestamp")
    # What mode m selects depends on the reference's last digit, n on nothing, p has no rows.
    text = lambda ref, mode: {"m": ref.rstrip("n")[-1], "n": "same"}.get(mode)
    refs = sorted({r[3].lower() for r in [*rules, *new]})
    tables = spark.createDataFrame([(r, {"M": m, "V": text(r, m)}) for r in refs for m in "mn"], "reference string, cells map<string,string>")
    effects = (tables, T.mode_registry(spark, {("cam", "dark"): ["M"], ("spec", "dark"): None})) if with_tables else None
    out = S.compared_references(df, (serve(serving_old), spark.createDataFrame(rules, RULE)), (serve(serving_new), spark.createDataFrame(new, RULE)), ["A", "B"], tables=effects)
    out = R.with_killed(out).collect()
    want = {}
    for d, i, p, t in rows:
        for kind in ("flat", "dark"):
            both = []
            for serving, context in ((serving_old, rules), (serving_new, new)):
                rmap = {(a, b): c for a, b, c in serving}.get((i, kind))
                both.append(resolved(best(context, (d, rmap, p, t)) if rmap else S.NOT_FOUND))
            (_, a), (ok, b) = both
            what = "error" if not ok else "update" if a != b else None
            files = not any(x == "N/A" or x.startswith("NOT FOUND") for x in (a, b))
            if what == "update" and with_tables and files and (i, kind) == ("cam", "dark") and text(a, p["M"]) == text(b, p["M"]):
                what = "no effect"
            if what:
                want[d, i, kind] = (a, b, what)
    killed = {d for (d, _, _), v in want.items() if v[2] == "error"}
    assert {(r.dataset_id, r.instrument, r.filekind): (r.old_reference, r.new_reference, r.kind) for r in out} == want and len(out) == len(want)
    assert {r.dataset_id for r in out if r.killed} == killed
    assert {v[2] for v in want.values()} == {"update", "error", *(["no effect"] if with_tables else [])}


def test_continuous_parameter(spark):
    """A hundred thousand numbers against bounds, texts and globs: as many classes as the bounds tell apart, and the right rules."""
    rng = random.Random(5)
    patterns = ["<10", ">=10", "between 3.5 70", "12.25", "1*|2*", "N/A", "*", "not >50", "# >20 and <60 #", "=30", "{77.0}", "(9.*)"]
    rules = [("r", [("X", p), ("G", g)], None, f"{p}/{g}") for p in patterns for g in ("A", "B|C", "N/A")]
    values = ["12.25", "10", "30", "30.0", "77.0", "N/A", "*", "soon", *(f"{rng.random() * 100:.9f}" for _ in range(100_000))]
    rows = [(str(k), "r", {"X": v, "G": "ABCD"[k % 4]}) for k, v in enumerate(values)]
    heads = spark.createDataFrame(rows, "dataset_id string, rmap string, params map<string,string>")
    distinct = heads.select(F.lit(0).alias("i"), F.col("params")["X"].alias("value")).distinct()
    classes = value_classes(distinct, spark.createDataFrame([(0, p) for p in patterns], "i int, pattern string"))
    assert classes.count() == len(set(values)) and classes.select("class").distinct().count() < 60
    got = S.weighted_match(heads, spark.createDataFrame(rules, RULE), ["X", "G"]).select("dataset_id", "reference", "weight")
    # Every value with every pattern, one parameter at a time.
    fits = {}
    for name, texts in (("X", patterns), ("G", ["A", "B|C", "N/A"])):
        pairs = heads.select(F.col("params")[name].alias(name)).distinct().join(spark.createDataFrame([(t,) for t in texts], "p string"), how="cross")
        fits[name] = pairs.select(name, F.col("p").alias(f"p{name}"), match_status(F.col(name), F.col("p")).alias(f"s{name}")).where(f"s{name} >= 0")
    want = heads.select("dataset_id", F.col("params")["X"].alias("X"), F.col("params")["G"].alias("G")).join(fits["X"], "X").join(fits["G"], "G")
    want = want.select("dataset_id", F.concat_ws("/", "pX", "pG").alias("reference"), (F.col("sX") + F.col("sG")).alias("weight"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 100_000


def test_walks_are_equi_joins(spark, world):
    """No pair of tuples and keys is formed to be thrown away: no nested loop, no product."""
    rules, heads = world
    tuples = spark.createDataFrame([("r", ["x", "1"])], "rmap string, tuple array<string>")
    fit = meet(tuples.select(F.lit("").alias("kind"), F.col("rmap").alias("group"), "tuple"), spark.createDataFrame([("r", ["x", "N/A"])], "group string, key array<string>"), spark.createDataFrame([("", 0, "x", "x", 1), ("", 1, "1", "N/A", 0)], "kind string, i int, value string, pattern string, score int"), 2)
    plan = fit._jdf.queryExecution().toString()
    assert [tuple(r) for r in fit.select("tuple", "key", "score").collect()] == [(["x", "1"], ["x", "N/A"], 1)]
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_follow_the_spans(spark):
    """One date far away leaves the cells of the others narrow."""
    spans = [("k", day(n), day(n + 1), n) for n in range(2000)] + [("k", dt.datetime(1900, 1, 1), day(0), -1)]
    rows = spark.createDataFrame([("k", day(n) + dt.timedelta(hours=5)) for n in range(-5, 2005)], "g string, t timestamp")
    out = span_join(rows, spark.createDataFrame(spans, "g string, low timestamp, high timestamp, n int"), ["g"], "t")
    assert {(r.t, r.n) for r in out.collect()} == {(day(n) + dt.timedelta(hours=5), -1 if n < 0 else n if n < 2000 else None) for n in range(-5, 2005)}


def test_nearest_with_ties(spark):
    """Float distances tie far from the points: the smallest point counts, however many tie."""
    points = [("k", float(p), f"p{p}") for p in (1, 2, 3, 10, 11)] + [("far", 1e9 + p, f"q{p}") for p in range(40)]
    asked = [("k", v) for v in (0.0, 2.5, 6.5, 6.6, 99.0)] + [("far", 1e9 + v) for v in (7, 20, 500, 3e9)] + [("none", 1.0), ("k", None)]
    out = S.geometrically_nearest(spark.createDataFrame(asked, "g string, value double"), spark.createDataFrame(points, "g string, number double, reference string"), ["g"]).collect()
    import numpy as np

    for r in out:
        own = [(abs(np.float32(p) - np.float32(r.value)), p, n) for g, p, n in points if g == r.g] if r.value is not None else []
        assert r.reference == (min(own)[2] if own else S.NOT_FOUND), r
    assert len(out) == len(asked)


def test_bracket_edges(spark):
    points = spark.createDataFrame([("k", 1.0, "a"), ("k", 2.0, "b"), ("k", 4.0, "c")], "g string, number double, reference string")
    asked = spark.createDataFrame([("k", v) for v in (0.0, 1.0, 1.5, 4.0, 9.0)], "g string, value double")
    got = {r.value: (r.low_reference, r.high_reference) for r in S.bracket(asked, points, ["g"]).collect()}
    assert got == {0.0: ("a", "a"), 1.0: ("a", "a"), 1.5: ("a", "b"), 4.0: ("c", "c"), 9.0: ("c", "c")}


def test_all_types_of_an_instrument(spark, world):
    rules, heads = world
    serving = spark.createDataFrame([("cam", "flat", "r"), ("cam", "dark", "s"), ("spec", "dark", "s")], "instrument string, filekind string, rmap string")
    rows = [(h[0], "cam" if k % 2 else "spec", h[2], h[3]) for k, h in enumerate(heads)]
    df = spark.createDataFrame(rows, "dataset_id string, instrument string, params map<string,string>, exptime timestamp")
    dated = spark.createDataFrame(rules, RULE)
    got = {(r.dataset_id, r.filekind): r.reference for r in S.best_references(df, serving, dated, ["A", "B"]).collect()}
    want = {(d, kind): best(rules, (d, rmap, p, t)) for d, i, p, t in rows for j, kind, rmap in (("cam", "flat", "r"), ("cam", "dark", "s"), ("spec", "dark", "s")) if i == j}
    assert got == want
    assert {r.filekind for r in S.best_references(df, serving, dated, ["A", "B"], include=["flat"]).collect()} == {"flat"}


def test_hooks_through_the_registry(spark, world):
    rules, heads = world

    @hook("precondition", "r", "test_type")
    def _x_to_y(rows):
        return rows.withColumn("params", F.transform_values("params", lambda k, v: F.when((k == "A") & (v == "x"), "y").otherwise(v)))

    @hook("fallback", "s", "test_type")
    def _any_a(rows):
        return rows.withColumn("params", F.transform_values("params", lambda k, v: F.when(k == "A", "*").otherwise(v)))

    df = spark.createDataFrame(heads, HEADER)
    got = {r.dataset_id: r.reference for r in S.hooked_lookup(df, spark.createDataFrame(rules, RULE), ["A", "B"], "test_type").collect()}
    for d, rmap, params, t in heads:
        if rmap == "r":
            params = {k: "y" if (k, v) == ("A", "x") else v for k, v in params.items()}
        want = best(rules, (d, rmap, params, t))
        if want.startswith("NOT FOUND") and rmap == "s":
            again = best(rules, (d, rmap, {k: "*" if k == "A" else v for k, v in params.items()}, t))
            want = want if again.startswith("NOT FOUND") else again
        assert got[d] == ("N/A" if want == "N/A" else want)
    assert apply_hooks("update", "test_type", df).count() == len(heads)


def test_exempt_combinations(spark):
    df = spark.createDataFrame([("NOT FOUND x", {"D": "a", "G": "1"}), ("NOT FOUND x", {"D": "a"}), ("file", {"D": "a", "G": "1"}), ("NOT FOUND x", {"D": "c"})], "r string, p map<string,string>")
    got = [r.x for r in df.select(S.do_not_reprocess(F.col("r"), F.col("p"), [{"D": ["a", "b"], "G": ["1"]}, {"D": ["c"]}]).alias("x")).collect()]
    assert got == ["N/A", "NOT FOUND x", "file", "N/A"]
