"""Scores of whole texts against context-tree weighting done node by node, and odd inputs."""

import math
import zlib

import numpy as np

from rulewright.llm import ctw

DOCS = "doc_id long, text string"


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def decisions(text, depth=4):
    """(context, node, bit) of every decision of a text."""
    data = bytes(depth) + text.lower().encode() + b"\0"
    for p in range(depth, len(data)):
        for d in range(depth + 1):
            for k in range(8):
                yield data[p - d : p], (1 << k) | (data[p] >> (8 - k)), (data[p] >> (7 - k)) & 1


def brute(train, texts, depth=4):
    counts, below = {}, {}
    for t in train:
        for c, node, bit in decisions(t, depth):
            counts.setdefault((c, node), [0, 0])[bit] += 1
            if c:
                below.setdefault((c[1:], node), set()).add((c, node))
    known = {}

    def weighted(key):
        if key not in known:
            own = kt(*counts.get(key, (0, 0)))
            known[key] = own if len(key[0]) == depth else math.log(0.5) + float(np.logaddexp(own, sum(weighted(k) for k in below.get(key, ()))))
        return known[key]

    def chance(context, node, bit):
        p = None
        for d in range(depth, -1, -1):
            key = (context[depth - d :], node)
            a, b = counts.get(key, (0, 0))
            own = ((b if bit else a) + 0.5) / (a + b + 1)
            if p is None:
                p = own
            else:
                stop = math.exp(math.log(0.5) + kt(a, b) - weighted(key))
                p = stop * own + (1 - stop) * p
        return p

    return [sum(math.log10(chance(c, node, bit)) for c, node, bit in decisions(t, depth) if len(c) == depth) for t in texts]


def test_scores_of_whole_texts(spark):
    texts = ["the cat sat on the mat", "The dog sat", "a cat, a dog", "", "zzz", "the cat sat on the mat", "äöü ñ", "on on on on"] * 3
    rows = [(k, t) for k, t in enumerate(texts)]
    train = [t for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    assert len(train) < len(rows)
    want = brute(train, texts)
    got = {r.doc_id: r.score for r in ctw.score_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(math.isclose(got[k], w, rel_tol=1e-9, abs_tol=1e-9) for k, w in enumerate(want))


def test_long_texts_come_in_parts(spark):
    """A text above two megabytes is read in parts; its score is that of its pieces' strings all the same."""
    long = "many words of a long text " * 100_000
    data = np.frombuffer(long.encode(), np.uint8)
    parts = np.concatenate([x for _, _, x, _ in ctw.grams(data, np.array([0, len(data)]))])
    whole = ctw._strings(np.concatenate([np.zeros(4, np.uint8), data, np.zeros(1, np.uint8)]))
    assert (parts == whole).all()
    out = ctw.score_documents(spark.createDataFrame([(1, long), (None, "a"), (None, "b"), (2, "x"), (2, "x")], DOCS)).collect()
    assert len(out) == 5 and {r.n_tokens for r in out if r.doc_id == 1} == {600_001}
    assert len({r.score for r in out if r.doc_id == 2}) == 1
