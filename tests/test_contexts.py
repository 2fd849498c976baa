"""Reachability of any depth and differences of trees that open only what differs."""

import random

from rulewright.operators import contexts as C
from rulewright.operators import reach


def brute(links, root):
    seen, front, depth = {root: 0}, [root], 0
    while front:
        depth += 1
        front = [b for b in {b for a, b in links if a in set(front)} if b not in seen]
        seen |= dict.fromkeys(front, depth)
    return seen


def found(spark, links, roots):
    df = spark.createDataFrame(links, "a long, b long")
    out = reach.reachable(df, spark.createDataFrame([(r, r) for r in roots], "root long, node long")).collect()
    assert len(out) == len({(r.root, r.node) for r in out})
    return {r: {x.node: x.depth for x in out if x.root == r} for r in roots}


def test_random_graphs(spark, monkeypatch):
    rng = random.Random(3)
    for widest in (20, 0.01):  # doubled steps, and single steps again after one doubling
        monkeypatch.setattr(reach, "WIDEST", widest)
        monkeypatch.setattr(reach, "LEVELS", 2)
        links = [(k, k + 1) for k in range(40)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(15)] + [(5, 5), (7, None), (39, 3)]
        for root, got in found(spark, links, [0, 50, 99]).items():
            assert got == brute([x for x in links if None not in x], root)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds, real = [], reach.stored
    monkeypatch.setattr(reach, "stored", lambda df, name: rounds.append(name) or real(df, name))
    n = 10_000
    links = spark.range(n).selectExpr("id as a", "id + 1 as b")
    out = reach.reachable(links, spark.createDataFrame([(0, 0)], "root long, node long"))
    assert out.where("depth = node").count() == n + 1 == out.count() and rounds.count("level") <= 20


def test_equal_subtrees_are_not_opened(spark):
    """Below an equal checksum there is a difference that must not be seen, as it is never looked at."""
    edge = "parent string, key string, child string, sha string"
    old = [("r1", "same", "s1", "x"), ("s1", "k", "a", "1"), ("r1", "rep", "p1", "y1"), ("p1", "f", "f1", "1"), ("p1", "g", "g", "2"), ("r1", "gone", "q1", "z"), ("q1", "h", "h1", "3")]
    new = [("r2", "same", "s2", "x"), ("s2", "k", "b", "9"), ("r2", "rep", "p2", "y2"), ("p2", "f", "f2", "7"), ("p2", "g", "g", "2"), ("r2", "more", "m2", "w"), ("m2", "i", "i2", "4")]
    a, b = spark.createDataFrame(old, edge), spark.createDataFrame(new, edge)
    rows = lambda df: {tuple(r) for r in df.collect()}
    top = {("rep", "replaced", "p1", "p2"), ("rep/f", "replaced", "f1", "f2"), ("gone", "deleted", "q1", None), ("more", "added", None, "m2")}
    assert rows(C.diff_contexts(a, b, "r1", "r2")) == top
    assert rows(C.diff_contexts(a, b, "r1", "r2", expand=True)) == top | {("gone/h", "deleted", "h1", None), ("more/i", "added", None, "i2")}
    assert rows(C.diff_contexts(a, a, "r1", "r1")) == set()
