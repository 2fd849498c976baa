"""Mixing against brute force: targets, wanted copies, the order of the sample, and inclusion frequencies."""

import math
import random

from pyspark.sql import functions as F

from rulewright.llm import mixing
from rulewright.llm.mixing import mix_sources

DOCS = "doc_id long, source string, text string"


def brute_targets(sizes, most=3):
    """Share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), dict.fromkeys(sizes, 0.0), set(sizes)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if target[s] + share[s] >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] += share[s]
            break
        for s in over:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= over
    return target


def brute_wanted(docs, target, most=3):
    """The factor by bisection: docs are (size, emphasis)."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(most, mid * e) for n, e in docs) < target else (low, mid)
    return [min(most, high * e) for _, e in docs]


def test_every_number_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c", "d", None]), " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300])))) for k in range(1500)]
    df = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in mix_sources(df, fit_last=False).collect()}
    u = {r.doc_id: r.u for r in df.select("doc_id", mixing._uniform(20).alias("u")).collect()}
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = brute_targets(sizes)
    for s in sizes:
        own = [(k, len(t.split())) for k, x, t in rows if x == s]
        emphasis = [2 ** (round(math.log2(1 + math.log2(1 + n) / 4) * 8) / 8) for _, n in own]
        wanted = brute_wanted([(n, e) for (_, n), e in zip(own, emphasis)], target[s])
        whole = [math.floor(w + 1e-9) for w in wanted]
        rest = target[s] - sum(w * n for w, (_, n) in zip(whole, own))
        ranked = []
        for (k, n), w, c in zip(own, wanted, whole):
            r = out[k]
            assert math.isclose(r.target, target[s], rel_tol=1e-9) and r.source_size == sizes[s]
            assert math.isclose(r.wanted, w, rel_tol=1e-6)
            p = min(1 - 1e-9, max(1e-9, w - c))
            if w - c > 0:
                ranked.append(((u[k] / (1 - u[k])) * (1 - p) / p, k, n))
        taken, chosen = 0, set()
        for _, k, n in sorted(ranked):
            if taken + n > rest + 1e-6:
                break
            taken += n
            chosen.add(k)
        for (k, n), c in zip(own, whole):
            assert out[k].copies == (min(3, c + (k in chosen)) if n else 0)


def test_inclusion_frequencies(spark):
    """Many sources of thirty documents of one size: each is taken as often as its odds say."""
    rows = [(s * 30 + k, f"s{s:04d}", " ".join("w" for _ in range(10)), [1.0, 2.0, 4.0][k % 3]) for s in range(300) for k in range(30)]
    df = spark.createDataFrame(rows, DOCS + ", e double")
    out = mix_sources(df, emphasis=F.col("e"), fit_last=False).groupBy("e", F.round("wanted", 6).alias("w")).agg(F.avg("copies").alias("c"), F.count("*").alias("n")).collect()
    # Targets differ by the weight of the source (1, 2, 3), so each emphasis has three wanted numbers.
    assert len(out) == 9 and all(r.n == 1000 for r in out)
    for r in out:
        assert abs(r.c - r.w) < 0.06, (r.e, r.w, r.c)


def test_odd_inputs(spark):
    wide = "doc_id long, source string, text string, rest string, bin int, order int, goal_source string, wanted int, _e int"
    rows = [(1, "a", "x y", "r", 1, 2, "g", 3, 4), (1, "a", "x y", "r", 1, 2, "g", 3, 4), (2, None, None, None, None, None, None, None, None), (None, "a", "z", "r", 0, 0, "g", 0, 0), (3, "b", "", "r", 1, 1, "g", 1, 1)]
    out = mix_sources(spark.createDataFrame(rows, wide)).collect()
    assert len(out) == 5 and {r.rest for r in out} == {"r", None} and all(r.copies == 0 for r in out if r["size"] == 0)
    assert mix_sources(spark.createDataFrame([], wide)).collect() == []
    long = " ".join(f"w{k}" for k in range(300_000))
    big = {r.doc_id: r["size"] for r in mix_sources(spark.createDataFrame([(1, "a", long), (2, "b", "x")], DOCS)).collect()}
    assert big == {1: 300_000, 2: 1}
