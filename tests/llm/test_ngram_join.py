import random
import re

import numpy as np

from rulewright.llm import ngram_join
from rulewright.llm.graph import components
from rulewright.llm.ngram_join import bands, jaccard_classes, part_keys

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows, size, p, q):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and q * both >= p * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    passage = rng.choices(vocabulary, k=60)  # shared by many, makes none of them near copies
    for g in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 9, 15, 40, 120, 400]))
        for _ in range(rng.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if g % 5 == 0 and len(w) > 100:
                w[10:10] = passage
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else " ".join(w), "clash"))
    rows += [(len(rows), "", "x"), (len(rows) + 1, None, "x"), (len(rows) + 2, " \n\t", "x"), (len(rows) + 3, "one two", "x"), (len(rows) + 4, "ONE  two", "x")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = rng.choices([f"v{k}" for k in range(500)], k=150)
    rows = [(0, " ".join(base), "")]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.choice([1, 3, 4])):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), ""))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, SCHEMA), 5, 80, 100).collect()}
    assert got == brute(rows, 5, 80, 100)


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_linked_sets_share_a_key():
    """Sets that differ in as many elements as a link allows share a key, small and large ones alike."""
    rng = np.random.default_rng(1)
    starts = bands(85, 100)
    for _ in range(400):
        n = int(rng.integers(6, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = 0
        while (len(a) - drop - 1) * 100 >= 85 * (len(a) + 0):
            drop += 1
        b = np.sort(rng.choice(a, len(a) - drop, replace=False))
        assert np.intersect1d(part_keys(a, starts, 85, 100), part_keys(b, starts, 85, 100)).size


def test_keys_grow_with_the_set():
    """Long sets have keys in proportion to their size, share them when linked and share none when they have nothing in common."""
    rng = np.random.default_rng(2)
    for p in (80, 85):
        starts = bands(p, 100)
        for n in (100, 1_000, 3_000, 20_000, 200_000):
            a, other = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
            b = np.sort(rng.choice(a, -(-n * p // 100), replace=False))
            keys = [part_keys(x, starts, p, 100) for x in (a, b, other)]
            assert max(len(k) for k in keys) < 2 * n
            assert np.intersect1d(keys[0], keys[1]).size and not np.intersect1d(keys[0], keys[2]).size


def test_sets_no_deal_fits_share_a_key(monkeypatch):
    """Where every deal leaves too many parts empty in both sets, the keys after the last deal must bring them together."""
    monkeypatch.setattr(ngram_join, "tile_parts", lambda low, most: (4 * most + 8, 0))
    monkeypatch.setattr(ngram_join, "_DEALS", 0)
    rng = np.random.default_rng(4)
    for p in (50, 80, 85):
        starts = bands(p, 100)
        for _ in range(300):
            n = int(rng.integers(8, 300))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.sort(rng.choice(a, -(-n * p // 100), replace=False))
            assert np.intersect1d(part_keys(a, starts, p, 100), part_keys(b, starts, p, 100)).size


def test_passes_part_the_keys():
    """Every key of a set belongs to one pass, and no pass has much more than its share: disk holds the keys of one pass."""
    rng = np.random.default_rng(6)
    starts = bands(80, 100)
    total = np.zeros(ngram_join.PASSES)
    for n in (1, 4, 7, 60, 400, 401, 3_000, 50_000):
        found = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        each = [part_keys(found, starts, 80, 100, only) for only in range(ngram_join.PASSES)]
        assert sorted(np.concatenate(each)) == sorted(part_keys(found, starts, 80, 100))
        total = total + [len(x) for x in each]
    assert ngram_join.PASSES > 1 and max(total) < 0.6 * sum(total)


def test_each_pass_stores_its_own_shared_keys(spark, monkeypatch):
    """The keys are never shuffled all at once, and the classes are those of one pass over all of them."""
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.choice([6, 30, 90]))), "") for k in range(30)]
    rows += [(100 + k, t + " tail", "") for k, t, _ in rows]
    names, real = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: names.append(name) or real(df, name))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, SCHEMA), 4, 80, 100).collect()}
    assert got == brute(rows, 4, 80, 100) and names.count("shared") == ngram_join.PASSES


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (50, 50), (102, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}


def test_documents_without_an_id(spark):
    """They hold a chain together, and a component of such documents alone has no id."""
    words = [f"w{k}" for k in range(70)]
    text = lambda n: " ".join(words[:n])
    alone = " ".join(f"v{k}" for k in range(40))
    rows = [(None, text(60)), (1, text(61)), (2, text(62)), (None, alone), (None, alone), (None, None), (None, ""), (5, "other words entirely and some more of them")]
    out = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), size=4, p=85, q=100)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)
    want = [(None, 57, 1), (1, 58, 1), (2, 59, 1), (None, 37, None), (None, 37, None), (None, 0, None), (None, 0, None), (5, 5, 5)]
    assert got == sorted(want, key=str)
