"""Work that must not grow with repeated values, and inputs made by a cheaper plan."""

import random
from datetime import datetime

from rulewright.catalogue import inputs
from rulewright.operators import nesting as N
from rulewright.operators import reprocess as R
from rulewright.operators import selection as S
from rulewright.operators import steps


def test_nested_levels_see_each_question_once(spark, monkeypatch):
    seen = []

    def level(rows, *more, real=N._level):
        seen.append(rows.count())
        return real(rows, *more)

    monkeypatch.setattr(N, "_level", level)
    shape = "rmap string, levels array<struct<class:string,par:string>>, keys array<string>, reference string"
    bracket, after = [("Match", "A"), ("Bracket", "Q")], [("Match", "A"), ("UseAfter", "")]
    rules = [("b", bracket, ["A=x", "1"], "r1"), ("b", bracket, ["A=x", "5"], "r5"), ("b", bracket, ["A=x", "5"], "r0"), ("u", after, ["A=x", "2000-01-01 00:00:00"], "r2000")]
    times = [datetime(1999, 1, 1), datetime(2001, 1, 1), None]
    heads = [(f"d{i}", r, {"A": "x", "Q": "3", "other": str(i)}, times[i % 3]) for i in range(30) for r in ("b", "u", "none")]
    out = N.nested_selectors(spark.createDataFrame(heads, "dataset_id string, rmap string, params map<string,string>, exptime timestamp"), spark.createDataFrame(rules, shape)).collect()
    want = {"b": ["r1,r5"] * 3, "u": ["NOT FOUND No match found.", "r2000", "NOT FOUND No match found."], "none": ["NOT FOUND No match found."] * 3}
    assert {(r.dataset_id, r.rmap): r.reference for r in out} == {(h[0], h[1]): want[h[1]][int(h[0][1:]) % 3] for h in heads} and len(out) == 90
    # One question of the set that does not look at the time, three of the one that does.
    assert sorted(seen) == [1, 1, 3, 3]


def test_whole_contexts_open_what_has_the_same_checksum(spark):
    from rulewright.operators import contexts as C

    shape = "parent string, key string, child string, sha string"
    old = spark.createDataFrame([("r1", "k", "m", "s"), ("m", "x", "x1", "1"), ("m", "g", "g1", "1"), ("g1", "h", "h1", "1")], shape)
    new = spark.createDataFrame([("r2", "k", "m2", "s"), ("m2", "x", "x2", "2"), ("m2", "y", "y2", "2")], shape)
    want = {("k/x", "replaced", "x1", "x2"), ("k/g", "deleted", "g1", None), ("k/g/h", "deleted", "h1", None), ("k/y", "added", None, "y2")}
    out = C.diff_whole_contexts(old, new, "r1", "r2").collect()
    assert set(map(tuple, out)) == want and len(out) == 4
    assert C.diff_whole_contexts(old, old, "r1", "r1").isEmpty()


def test_datasets_by_order_are_those_of_the_sql(spark):
    line = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_quantity double, l_shipdate timestamp"
    day = [datetime(2000, 1, d) for d in (1, 2, 3)]
    lines = [(1, 1, 7, 3, "R", 10.0, day[0]), (1, 1, 7, 3, "A", 7.5, day[1]), (1, 2, 7, 3, None, None, None), (2, 1, 8, 3, "N", 3.0, day[2]), (9, 1, 1, 1, "N", 3.0, day[2])]
    orders = [(1, 5, "2-HIGH", "F"), (1, 6, "1-URGENT", "O"), (2, 5, None, "P"), (3, 5, "x", "P"), (4, 77, "x", "P")]
    customers = [(5, "HOUSEHOLD"), (6, "BUILDING"), (6, None)]

    def made(lines):
        frames = {"lineitem": spark.createDataFrame(lines, line), "orders": spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string"), "customer": spark.createDataFrame(customers, "c_custkey bigint, c_mktsegment string")}
        return inputs.datasets_by_order(**frames), spark.sql(inputs.INPUTS["datasets"], **frames)

    mine, sql = made(lines)
    assert mine.schema == sql.schema and sorted(map(str, mine.collect())) == sorted(map(str, sql.collect())) and mine.count() == 3
    # Ids without a key fall together, which only the SQL does.
    assert made([*lines, (1, None, 7, 3, "R", 1.0, day[0])])[0] is None


RULE = "rmap string, match_key array<struct<par:string,pattern:string>>, useafter timestamp, reference string"


def _world(spark, n=120):
    """Datasets of two instruments and rules of two types, of which errors come from unknown times."""
    r = random.Random(5)
    day = lambda: datetime(2000, 1 + r.randrange(12), 1 + r.randrange(28))
    heads = [(f"d{i}", r.choice(["i", "j", "k"]), {"A": r.choice("xyz"), "B": r.choice(["1", "2"])}, None if r.random() < 0.1 else day()) for i in range(n)]
    rule = lambda: (r.choice(["i_p", "i_q", "j_p"]), [("A", r.choice(["x", "y|z", "*", "N/A"])), ("B", r.choice(["1", "N/A"]))], day() if r.random() < 0.9 else None, r.choice(["NOT FOUND broken", "f1", "f2", "f3", "f4"]))
    old, new = ([rule() for _ in range(40)] for _ in range(2))
    serving = spark.createDataFrame([("i", "p", "i_p"), ("i", "q", "i_q"), ("j", "p", "j_p")], "instrument string, filekind string, rmap string")
    return spark.createDataFrame(heads, "dataset_id string, instrument string, params map<string,string>, exptime timestamp"), serving, spark.createDataFrame(old, RULE), spark.createDataFrame(new, RULE)


def test_killed_is_known_before_datasets_are_met(spark):
    rows, serving, old, new = _world(spark)
    found = S.compared_references(rows, (serving, old), (serving, new), ["A", "B"])
    mine = S.compared_references(rows, (serving, old), (serving, new), ["A", "B"], killed=True)
    want = sorted(map(str, R.with_killed(found).collect()))
    assert sorted(map(str, mine.collect())) == want
    assert any("killed=True" in w and "kind='update'" in w for w in want) and any("killed=False" in w for w in want)
    # One join of the datasets with their class and one with the spans.
    assert mine._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_same_results_stay_and_equal_the_join_of_both_contexts(spark, monkeypatch):
    rows, serving, old, new = _world(spark)
    want = R.compare_references(*(S.best_references(rows, serving, r, ["A", "B"]) for r in (old, new)))
    want = sorted(map(str, want.collect()))
    for most in (steps.BROADCAST_SPANS, 0):
        monkeypatch.setattr(steps, "BROADCAST_SPANS", most)
        mine = S.compared_references(rows, (serving, old), (serving, new), ["A", "B"], same=True)
        assert sorted(map(str, mine.collect())) == want
    # Rows that are shuffled carry a number, not their class; and they are not sorted.
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "class" not in plan


def test_ambiguous_tuples_are_those_of_the_matches(spark):
    rows, _, old, _ = _world(spark)
    heads, rules = rows.withColumn("rmap", rows["instrument"]).drop("instrument"), old.selectExpr("substring(rmap, 1, 1) as rmap", "match_key", "date_trunc('quarter', useafter) as useafter", "reference")
    heads = heads.selectExpr("rmap", "params['A'] as a", "params['B'] as b").distinct().selectExpr("rmap", "map('A', a, 'B', b) as params")
    matched = S.weighted_match(heads, rules, ["A", "B"]).selectExpr("*", "array(params['A'], params['B']) as dataset_id")
    want = S.ambiguous_matches(matched).selectExpr("rmap", "dataset_id as tuple", "weight", "useafter", "n_rules", "reference")
    mine = S.ambiguous_tuples(heads, rules, ["A", "B"])
    assert sorted(map(str, mine.collect())) == sorted(map(str, want.collect())) and not mine.isEmpty()


def test_few_versions_are_broadcast(spark):
    """A config is found for many rows of few versions: no task gets the rows of a whole version."""
    rows = spark.range(1000).selectExpr("id", "case when id % 2 = 0 then '1.0' else '2.0' end as cal_ver")
    out = S.with_config(rows, spark.createDataFrame([("1.0", "a"), ("2.0", "b")], "first_version string, config string"))
    assert out.groupBy("cal_ver", "config").count().count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_cases_of_single_results_need_no_grouping_by_dataset(spark):
    rows = spark.createDataFrame([("a", "i", "t", "f1"), ("b", "i", "t", "f1"), ("c", "j", "t", "f1")], "dataset_id string, instrument string, filekind string, reference string")
    mine = R.cases_of_sets(rows.selectExpr("dataset_id", "instrument", "'t=' || reference as results"))
    assert sorted(map(str, mine.collect())) == sorted(map(str, R.coverage_cases(rows).collect()))
