"""Table effects, row differences and ambiguous keys against plain Python."""

import random

import pytest

from rulewright.operators import diffs as D
from rulewright.operators import tables as T


def number(text):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip()


def selects(cell, value, wildcards, metavalues):
    """What a table's cell does for a header's value."""
    cell, value = number(cell), number(value)
    if cell in map(number, wildcards):
        return True
    if value in {number(k): v for k, v in metavalues.items()}:
        return cell in [number(v) for v in metavalues[str(value)]]
    if isinstance(value, str):
        return isinstance(cell, str) and cell in value
    return cell == value


def test_effects_against_brute_force(spark):
    rng = random.Random(8)
    fields = {"OPT": (["ANY"], {}), "SEG": (["ANY", "ALL"], {"BOTH": ["FUVA", "FUVB"]}), "CEN": (["-1"], {})}
    values = {"OPT": ["G1", "G14", "G140L", "ANY", "2"], "SEG": ["FUVA", "FUVB", "ALL", "ANY", "FUV", ""], "CEN": ["1280", "1280.0", "-1", "ANY", "x"]}
    heads = {"OPT": ["G140L", "G1", "2.0", "Z"], "SEG": ["FUVA", "BOTH", "FUVAB", "9"], "CEN": ["1280", "1291", "-1", "x"]}
    tables = {r: [{**{f: rng.choice(v) for f, v in values.items()}, "V": str(rng.randrange(2))} for _ in range(rng.choice([3, 12, 40]))] for r in "abcd"}
    tables["d"] = [dict(c) for c in tables["c"][::-1]]  # the same rows in another order
    tables["e"] = [{**c, "MORE": "1"} for c in tables["a"]]
    rows = [(r, c) for r, cells in tables.items() for c in cells]
    updates = []
    for k in range(500):
        params = {f: rng.choice(v) for f, v in heads.items()}
        if k % 17 == 0:
            params["OPT"] = rng.choice(["UNDEFINED", None])
        a, b = rng.sample(["a", "b", "c", "d", "e", "N/A", "gone"], 2)
        updates.append((f"d{k}", "cam", rng.choice(["modes", "modes", "always", "other"]), a, b, params))

    def required(u):
        _, _, kind, a, b, params = u
        if kind != "modes" or a not in tables or b not in tables or None in params.values() or "UNDEFINED" in params.values():
            return True
        if set(tables[a][0]) != set(tables[b][0]):
            return True
        chosen = [sorted(str(sorted(c.items())) for c in tables[r] if all(selects(c[f], params[f], *rule) for f, rule in fields.items())) for r in (a, b)]
        return chosen[0] != chosen[1]

    registry = T.mode_registry(spark, {("cam", "modes"): [T.ModeField(f, tuple(w), m) for f, (w, m) in fields.items()], ("cam", "always"): None})
    df = spark.createDataFrame(updates, "dataset_id string, instrument string, filekind string, old_reference string, new_reference string, params map<string,string>")
    out = T.effective_updates(df, spark.createDataFrame(rows, "reference string, cells map<string,string>"), registry)
    got = {r.dataset_id for r in out.collect()}
    want = {u[0] for u in updates if required(u)}
    assert got == want and len(want) < len(updates)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def covers(a, b):
    """Pattern ``a`` is at least as general as ``b``."""
    x, y = set(a.split("|")), set(b.split("|"))
    return a == b or a == "*" or b == "N/A" or (a == "N/A" and b == "*") or (b != "*" and a != "N/A" and x > y)


@pytest.mark.parametrize(("a", "b", "want"), [("7|q", "7", True), ("7", "7|q", False), ("*", "7", True), ("7", "*", False), ("7|q", "7|r", False), ("u|v|w|z", "u|v|w", True), ("u|v|w", "u|v|w|z", False), ("N/A", "7", False), ("7", "N/A", True), ("*", "N/A", True), ("N/A", "*", True), ("7", "8", False)])
def test_one_field(spark, a, b, want):
    found = D.covering_patterns(spark.createDataFrame([("", 0, x) for x in {a, b}], "kind string, i int, pattern string"))
    assert ((b, a) in {(r.value, r.pattern) for r in found.collect()}) == want == covers(a, b)


def test_ambiguous_keys_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["*", "N/A", "1", "2", "1|2", "1|2|3", "2|3", "4"]
    keys = {(rng.choice("rs"), tuple(rng.choice(pool) for _ in range(4))) for _ in range(300)}
    rows = [(g, [(p, x) for p, x in zip("ABCD", k)]) for g, k in keys]
    out = D.ambiguous_rules(spark.createDataFrame(rows, "rmap string, match_key array<struct<par:string,pattern:string>>"))
    want = set()
    for g, sub in keys:
        for h, top in keys:
            weight = sum((b == "N/A") - (a == "N/A") for a, b in zip(top, sub) if (a == "N/A") != (b == "N/A"))
            if g == h and sub != top and all(map(covers, top, sub)) and weight == 0:
                want.add((g, sub, top))
    assert {(r.rmap, tuple(r.covered), tuple(r.covering)) for r in out.collect()} == want and want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_mode_select(spark):
    df = spark.createDataFrame([("G1", "1"), ("ANY", "-1"), ("G140L", "2.0"), ("X", "2")], "opt string, cen string")
    rows = lambda c, w=None: {tuple(r) for r in T.mode_select(df, c, w).collect()}
    assert rows({"opt": "G140L"}) == {("G1", "1"), ("ANY", "-1"), ("G140L", "2.0")}
    assert rows({"cen": "2"}) == {("G140L", "2.0"), ("X", "2")}
    assert rows({"cen": "2"}, {"cen": ["-1"]}) == {("ANY", "-1"), ("G140L", "2.0"), ("X", "2")}
    assert rows({"opt": ["X", "G1"], "cen": "1.0"}) == {("G1", "1")}


def test_change_of_row_format(spark):
    old = spark.createDataFrame([(1, "A", 1.0, "x"), (2, "B", 2.0, "y")], "row_no long, mode string, v double, w string")
    new = spark.createDataFrame([(1, "A", 1.0, 5), (2, "B", 3.0, 6), (3, "C", 1.0, 7)], "row_no long, mode string, v double, more int")
    assert [tuple(r) for r in T.check_table_modes(old, new, ["mode", "absent"], ["v", "w"]).collect()] == [(None, "row format")]
    assert T.check_table_modes(old.limit(0), new, ["mode"], ["v"]).isEmpty()
    found = {tuple(r) for r in T.check_table_modes(old, new.withColumnRenamed("more", "w"), ["mode"], ["v"]).collect()}
    assert found == {("B", "changed"), ("C", "new")}
    assert T.check_table_modes(old, old, ["mode"], ["v", "w"]).isEmpty()
    with pytest.raises(ValueError):
        T.check_table_modes(old, new, ["absent"], ["v"])
