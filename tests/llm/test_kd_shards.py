"""The k-d tree against a brute-force tree, and where large groups go."""

import collections
import random

import pytest

from rulewright.llm import kd_shards
from rulewright.llm.kd_shards import kd_leaves, placed_large, shard_documents

POINT = "bytes long, tie long, source double, language double, length double"
DOCS = "doc_id long, text string, source string, lang string"


def brute_leaves(points, room):
    """Shard of each point: cut every node after the row whose middle is the last at or below the goal."""
    scale = [max(max(p[2 + d] for p in points) - min(p[2 + d] for p in points), 1e-9) for d in range(3)]
    out = {}

    def grow(rows, node, k):
        if k == 1 or not rows:
            out.update({id(p): node for p in rows})
            return
        spread = [max(p[2 + d] for p in rows) - min(p[2 + d] for p in rows) for d in range(3)]
        wide = max(range(3), key=lambda d: spread[d] / scale[d])
        low, width = min(p[2 + wide] for p in rows), max(spread[wide], 1e-9)
        place = lambda p: (min(255, int((p[2 + wide] - low) / width * 256)), (p[1] & (1 << 64) - 1) >> 1)
        rows = sorted(rows, key=place)
        whole, below = sum(room[node : node + k]), sum(room[node : node + k // 2])
        goal = sum(p[0] for p in rows) * (below / whole if whole > 0 else (k // 2) / k)
        # The edge cell is the last that begins at or below the goal; outside it rows fall by cell alone.
        reached, cut = 0, 0
        for n, p in enumerate(rows):
            reached += p[0]
            if reached - p[0] / 2 <= goal:
                cut = n + 1
        grow(rows[:cut], node, k // 2)
        grow(rows[cut:], node + k // 2, k - k // 2)

    grow(points, 0, len(room))
    return [out[id(p)] for p in points]


@pytest.mark.parametrize("edge", [50_000, 3], ids=["one cell", "finer cells"])
@pytest.mark.parametrize("room", [[1.0] * 11, [1.0, 0.0, 0.5, 1.0, 0.0, 1.0, 0.2, 1.0]], ids=["even", "uneven"])
def test_tree_against_brute_force(spark, monkeypatch, edge, room):
    monkeypatch.setattr(kd_shards, "EDGE", edge)
    rng = random.Random(3)
    points = [(rng.randrange(16, 40), rng.randrange(-(1 << 63), 1 << 63), float(rng.choice([1, 1, 1, 2, 9])), float(rng.randrange(3)), rng.random() * 8) for _ in range(700)]
    df = spark.createDataFrame(points, POINT)
    got = {r.tie: r.shard for r in kd_leaves(df, room).collect()}
    assert [got[p[1]] for p in points] == brute_leaves(points, room)


def test_large_groups_stay_whole_where_a_shard_can_hold_them(spark):
    rng = random.Random(5)
    rows = [(k, "big " * 200, f"s{k % 3}", "en") for k in range(60)] + [(100 + k, "x" * 300 + str(k % 40), "s1", "fr") for k in range(400)]
    rows += [(1000 + k, "y" * rng.randrange(0, 900), f"source-{k % 50}", "en") for k in range(3000)]
    out = shard_documents(spark.createDataFrame(rows, DOCS), 8).collect()
    size, where = collections.Counter(), collections.defaultdict(set)
    for r in out:
        size[r.shard] += r["size"]
        where[r.text_crc32, r["size"]].add(r.shard)
    assert len(out) == len(rows) and max(size.values()) < 1.05 * sum(size.values()) / 8
    assert all(len(v) == 1 for v in where.values())


def test_placing():
    found, room = placed_large([(0.9, "a"), (0.8, "b"), (0.7, "c"), (0.3, "d")], [1.0, 1.0])
    assert found == {"a": 0, "b": 1} and [round(x, 6) for x in room] == [0.1, 0.2]
    assert placed_large([], []) == ({}, [])


def test_odd_inputs(spark):
    wide = DOCS + ", size int, tie int, shard string, own int, length double"
    rows = [(None, None, None, None, 1, 1, "s", 1, 1.0)] * 3 + [(5, "z" * 3_000_000, "s", "en", 1, 1, "s", 1, 1.0), (6, "a", "an eight-letter name", "en", 1, 1, "s", 1, 1.0)]
    out = shard_documents(spark.createDataFrame(rows, wide), 4).collect()
    assert len(out) == 5 and sorted(r["size"] for r in out) == [16, 16, 16, 17, 3_000_016]
    assert shard_documents(spark.createDataFrame([], wide), 4).collect() == []
