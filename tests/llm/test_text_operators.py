import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from rulewright.llm import ctw
from rulewright.llm.bpe import decode_documents, encode_documents
from rulewright.llm.kd_shards import shard_documents
from rulewright.llm.mixing import expanded, mix_sources
from rulewright.llm.quality_rules import quality_verdicts, with_counts
from rulewright.llm.queries import tokenizer_file

WORDS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()
    hard = ["", None, " ", "\n\n", "one", "a b c d e a b c d e a b c d e", "é è  x", "x|y <a> #1", "don't  we'll\n\n 's <|endoftext|> x", "z" * 3000 + " end", "🙂 🙂 🙂"]
    return [(r.doc_id, r.text) for r in rows] + [(10_000 + k, t) for k, t in enumerate(hard)]


def test_bpe_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = tokenizer_file()
    t = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, x, "clash") for i, x in texts], "doc_id long, text string, decoded string")
    for r in decode_documents(encode_documents(df, path), path).collect():
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == t.decode(want, skip_special_tokens=False)


def test_bpe_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(df, tokenizer_file()).collect() == []


def test_counts_against_brute_force(spark, texts):
    df = spark.createDataFrame([(i, x, -1) for i, x in texts], "doc_id long, text string, n_words long")
    for r in with_counts(df).collect():
        x = r.text or ""
        w = re.findall(WORDS, x)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [y for y in x.split("\n") if re.search(WORDS, y)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in x)


def test_quality_rules_find_junk_and_keep_clean(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    noise = [(100_000 + k, " ".join(f"word{(k * j) % 97}### x" for j in range(60))) for k in range(60)]
    good = [(200_000 + k, " ".join(f"plain{(k * 31 + j * j) % 997}" for j in range(80)) + " R&D.") for k in range(60)]
    both = docs.union(spark.createDataFrame(noise + good, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 0) for i, _ in noise] + [(i, 1) for i, _ in good], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_verdicts(both, labels).select("doc_id", "kept").collect()}
    assert all(out[i] for i, _ in good)
    assert sum(not out[i] for i, _ in noise) > 55


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_verdicts(df, none).collect()} == {1: True, 2: False}
    assert quality_verdicts(df.limit(0), none).collect() == []


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", "b", "b", "b", "c", None]), " ".join("w" for _ in range(rng.randrange(0, 60))), "x") for k in range(3000)]
    df = spark.createDataFrame([*rows, rows[5], (None, "a", "x y", "x"), (9999, "tiny", "w w", "x")], "doc_id long, source string, text string, target string")
    out = mix_sources(df).collect()
    assert len(out) == 3003
    by = collections.defaultdict(list)
    for r in out:
        assert r["size"] == len(re.findall(WORDS, r.text)) and 0 <= r.copies <= 3
        by[r.source].append(r)
    total = sum(r["size"] for r in out)
    assert math.isclose(sum(v[0].target for v in by.values()), total)
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r["size"] * r.copies for r in v) - v[0].target) <= 60
    assert sorted((r.doc_id or -1, r.copies) for r in out) == sorted((r.doc_id or -1, r.copies) for r in mix_sources(df.repartition(7)).collect())
    assert expanded(mix_sources(df)).count() == sum(r.copies for r in out)
    assert mix_sources(df.limit(0)).collect() == []


def test_shards(spark):
    rng = random.Random(4)
    rows = [(k, "copy " * 20 if k % 3 == 0 else "x" * rng.randrange(0, 900), rng.choice(["s1", "s2", None]), rng.choice(["en", "fr"]), 1) for k in range(3000)]
    rows += [(3000, None, None, None, 1), (None, "q", "s1", "en", 1), (7, "twice", "s1", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int")
    out = shard_documents(df, 16).collect()
    assert len(out) == len(rows)
    size, slots, shards = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        shards[r.text_crc32, r["size"]].add(r.shard)
    mean = sum(size.values()) / 16
    assert max(size.values()) < 1.15 * mean and min(size.values()) > 0.85 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(v) > 1 for v in shards.values()) == 1  # only the large group is split
    assert shard_documents(df.limit(0), 16).collect() == []


def sequential_ctw(data, depth):
    """Log probability of bytes by context-tree weighting, node by node: the block probability of the root."""
    counts = collections.defaultdict(lambda: [0, 0])
    padded = bytes(depth) + data
    contexts = set()
    for p in range(depth, len(padded)):
        x = padded[p]
        for d in range(depth + 1):
            c = padded[p - d : p]
            for k in range(8):
                node = (1 << k) | (x >> (8 - k))
                counts[c, node][(x >> (7 - k)) & 1] += 1
                contexts.add((c, node))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, node):
        own = kt(*counts[c, node])
        if len(c) == depth:
            return own
        below = sum(weighted(bytes([y]) + c, node) for y in range(256) if (bytes([y]) + c, node) in contexts)
        return math.log(0.5) + np.logaddexp(own, below)

    return weighted, counts, contexts


def test_tree_against_direct_recursion():
    data = b"abracadabra abracad"
    strings = next(ctw.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[2]
    keys, n = np.unique(strings, return_counts=True)
    weighted, counts, contexts = sequential_ctw(data + b"\0", ctw.DEPTH)
    for pair in np.unique((keys >> 8) & 65535):
        own = ((keys >> 8) & 65535) == pair
        tree = ctw.Subtree(keys[own], n[own])
        c = bytes([pair >> 8, pair & 255])
        for at, node in zip(tree.at[2].ravel(), tree.node.ravel()):
            assert math.isclose(tree.weighted[2][at], weighted(c, int(node)), rel_tol=1e-9, abs_tol=1e-9)
    x = np.array([0.5, 1, 1.5, 7.5, 100, 12345.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_scores(spark, texts):
    df = spark.createDataFrame([(i, x, 1.0) for i, x in texts] + [(None, "abc", 1.0)], "doc_id long, text string, score double")
    got = ctw.score_documents(df).collect()
    assert len(got) == len(texts) + 1
    low = {i: re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + [None] for i, x in [*texts, (None, "abc")]}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in low}
    c = collections.Counter(w for i, ws in low.items() if not held[i] for w in ws)
    total = sum(c.values())
    for r in got:
        ws = low[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    # Probabilities after a context sum to one.
    seen = [(k, 3) for k in range(97, 105)] + [((98 << 8) | k, 5) for k in range(97, 120)]
    every = spark.createDataFrame([(k, n) for k, n in seen] + [((98 << 8) | k, 0) for k in range(256) if not 97 <= k < 120], "key long, n long")
    values = [r.value for r in ctw.string_scores(every).collect() if r.key >> 8 == 98]
    assert len(values) == 256 and math.isclose(sum(10**v for v in values), 1, rel_tol=1e-9)
    assert ctw.score_documents(df.limit(0)).collect() == []


