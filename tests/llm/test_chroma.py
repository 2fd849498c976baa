"""Alignment of fingerprints against a brute-force aligner, and odd inputs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import chroma

PRINT = "id long, print array<int>"


def brute(prints, votes=4, errors=0.35):
    """Classes, then the best offset of each asked class with every other."""
    groups = {}
    for i, p in prints:
        groups.setdefault(tuple(p), []).append(i)
    classes = {min(v): k for k, v in groups.items() if k}
    asked = {min(v) for k, v in groups.items() if k and any(i % 20 == 0 for i in v)}
    runs = {c: [(k, x) for k, x in enumerate(p) if k == 0 or p[k - 1] != x] for c, p in classes.items()}
    out = {}
    for a in asked:
        found = []
        for b in classes:
            n = Counter(x - y for x, u in runs[a] for y, v in runs[b] if u == v) if a != b else Counter()
            n = {o: c for o, c in n.items() if c >= votes}
            if n:
                o = max(n, key=lambda o: (n[o], -abs(o), o))
                both = [(classes[a][k], classes[b][k - o]) for k in range(max(0, o), min(len(classes[a]), len(classes[b]) + o))]
                wrong = sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in both) / (32 * len(both))
                if wrong <= errors:
                    found.append((wrong, b, o))
        out[a] = (len(found), *(min(found) if found else (None, None, None)))
    return {i: (min(groups[tuple(p)]), out.get(min(groups[tuple(p)]))) for i, p in prints if p}


@pytest.mark.parametrize(("hits", "block"), [(1 << 21, 1 << 21), (40, 300)], ids=["whole", "small blocks"])
def test_alignment_against_brute_force(spark, monkeypatch, hits, block):
    monkeypatch.setattr(chroma, "HITS", hits)
    monkeypatch.setattr(chroma, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = rng.integers(-50, 50, 200).tolist()
    rows = []
    for i in range(90):
        p = base[(k := int(rng.integers(0, 120))) : k + int(rng.integers(1, 80))]
        if i % 3 == 0:
            p = [7] * int(rng.integers(0, 30)) + p  # silence that many share
        if i % 7 == 0:
            p = [x if rng.random() < 0.8 else int(rng.integers(-50, 50)) for x in p]
        rows.append((i, p))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, []), (320, [7] * 40), (321, [7] * 41), (322, [7, 8] * 20)]
    out = {r.id: r for r in chroma.align_recordings(spark.createDataFrame(rows, PRINT), F.col("id") % 20 == 0).collect()}
    assert len(out) == len(rows)
    for i, (own, want) in brute(rows).items():
        r = out[i]
        assert r.class_id == own
        if want is None:
            assert r.n_matches == 0 and r.best_match is None
        else:
            assert (r.n_matches, r.best_match, r.offset) == (want[0], want[2], want[3])
            assert want[1] is None or abs(r.bit_errors - want[1]) < 1e-12


def test_tone_prints_equal_the_two_steps(spark):
    df = spark.createDataFrame([(1, [0.1, -0.5, 0.3] * 20), (2, None), (3, []), (4, [float("nan"), 1.0] * 20)], "id long, levels array<double>")
    got = df.select(chroma.tone_prints(F.col("levels")).alias("a"), chroma.fingerprints(chroma.tones(F.col("levels"))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got[0].a) > 0 and got[1].a == []


def test_odd_inputs(spark):
    empty = chroma.align_recordings(spark.createDataFrame([], PRINT), F.col("id") % 20 == 0)
    assert empty.collect() == []
    rows = [(20, [1, 2, 3, 4, 5, 6], "x", 1), (20, [1, 2, 3, 4, 5, 6], "y", 2), (None, [1, 2, 3, 4, 5, 6], "z", 3), (21, None, "w", 4), (22, [9, 1, 2, 3, 4, 5, 6], "v", 5)]
    df = spark.createDataFrame(rows, "id long, print array<int>, class string, asked int")
    out = sorted(chroma.align_recordings(df, F.col("id") % 20 == 0).collect(), key=lambda r: (r.id is None, r.id or 0))
    assert [(r.id, r.class_id, r.n_matches) for r in out] == [(20, 20, 1), (20, 20, 1), (21, 21, 0), (22, 22, 0), (None, 20, 1)]
