"""LM scoring by context-tree weighting over bytes, beside a smoothed word unigram.

A text is its lower-cased UTF-8 bytes and an end byte.  Each byte is decomposed
into eight binary decisions; every (context of the last d bytes, decision) has a
Krichevsky-Trofimov estimate, and the estimates of all depths 0 to 4 are mixed
with the weights that context-tree weighting gives them after the training texts.

* Counting: tasks add up distinct 5-byte strings (and words) before the shuffle.
* The tree: strings are grouped by the two bytes before the last one, which makes
  each group a whole subtree of at most 2 ** 24 strings, however large the corpus.
  The eight decisions of a byte are trees of their own and are worked off one by one.
  What lies above, at most 256 x 255 decisions, is summed in Spark and finished on
  the driver.
* Scoring: texts are dealt into chunks of bounded bytes; each chunk asks once for
  each distinct string and word in it, and the answers meet its texts in one
  grouped join.  No table of counts is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _T, dropped, groups_of_rows, stored, text_bytes, word_hashes

DEPTH = 4
#: Bytes of text in a chunk, about.
CHUNK = 24 << 20
#: Distinct strings and words that a task holds before it hands them on.
HELD = 3_000_000
_SLICE = 1 << 20
_HALF = np.log(0.5)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, 5-byte strings and where each row's begin; a long text comes in several parts."""
    for i, j in groups_of_rows(offsets, _SLICE):
        n, lengths = j - i, np.diff(offsets[i : j + 1])
        own = offsets[i : j + 1] - offsets[i]
        if n == 1 and lengths[0] > 2 * _SLICE:
            text = np.concatenate([np.zeros(DEPTH, np.uint8), _T["lower"][data[offsets[i] : offsets[j]]], np.zeros(1, np.uint8)])
            for at in range(0, len(text) - DEPTH, _SLICE):
                part = _strings(text[at : at + _SLICE + DEPTH])
                yield i, j, part, np.array([0, len(part)])
            continue
        # Each text stands between four zeros and one.
        laid = np.zeros(own[-1] + (DEPTH + 1) * n, np.uint8)
        shift = np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, lengths)
        laid[np.arange(own[-1]) + shift] = _T["lower"][data[offsets[i] : offsets[j]]]
        inside = np.ones(len(laid), bool)
        begin = own[:-1] + np.arange(n) * (DEPTH + 1)
        for k in range(DEPTH):
            inside[begin + k] = False
        yield i, j, _strings(laid)[inside[DEPTH:]], own + np.arange(n + 1)


def _strings(laid: np.ndarray) -> np.ndarray:
    wide = laid.astype(np.int64)
    out = wide[DEPTH:].copy()
    for k in range(DEPTH):
        out |= wide[k : len(wide) - DEPTH + k] << (8 * (DEPTH - k))
    return out


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Word hashes as negative keys, apart from the strings, which are positive."""
    return (hashes | np.uint64(1 << 63)).view(np.int64)


END_WORD = -1


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate(keys)
    c = np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def training_counts(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, held_out)`` to (key, n): counts in training texts; a string only in other texts has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        counts: list = []
        raw: list = []

        def settle() -> None:
            if raw:
                for train in (True, False):
                    parts = [x for t, x in raw if t == train]
                    if parts:
                        k, c = np.unique(np.concatenate(parts), return_counts=True)
                        keys.append(k)
                        counts.append(c if train else np.zeros(len(k), np.int64))
                raw.clear()
                if len(keys) > 8:
                    k, c = _summed(keys, counts)
                    keys[:], counts[:] = [k], [c]

        def out() -> pa.RecordBatch:
            k, c = _summed(keys, counts)
            keys.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "n"])

        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = text_bytes(batch.column(1))
            for source in ("grams", "words"):
                blocks = grams(data, offsets) if source == "grams" else word_hashes(batch.column(1))
                for i, j, found, at in blocks:
                    away = np.repeat(held[i:j], np.diff(at))
                    if source == "words":
                        raw.append((True, word_keys(found[~away])))
                    else:
                        raw.append((True, found[~away]))
                        raw.append((False, found[away]))
                    if sum(len(x) for _, x in raw) > 1 << 22:
                        settle()
                        if sum(map(len, keys)) > HELD:
                            yield out()
            raw.append((True, np.full(int((~held).sum()), END_WORD, np.int64)))
        settle()
        if keys:
            yield out()

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# --- the context tree ---------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series after a shift."""
    down = np.zeros_like(x)
    y = x.copy()
    for _ in range(12):
        small = y < 12
        down[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - down


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a sequence with ``a`` zeros and ``b`` ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)


class Subtree:
    """Depths 2 to DEPTH below one pair of context bytes: counts, block and weighted probabilities of some decisions of a byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, decisions: range = range(8)) -> None:
        last = keys & 255
        steps = np.array(decisions)[:, None]
        self.node = (1 << steps) | (last[None, :] >> (8 - steps))
        self.bit = (last[None, :] >> (7 - steps)) & 1
        weight = np.broadcast_to(counts.astype(float), self.bit.shape)
        self.at, self.zeros, self.ones, self.kt, self.weighted = {}, {}, {}, {}, {}
        for d in range(DEPTH, 1, -1):
            context = (keys >> 8) & ((1 << (8 * d)) - 1)
            found, index = np.unique((context[None, :] << 8 | self.node).ravel(), return_inverse=True)
            index = index.reshape(self.node.shape)
            self.at[d] = index
            flat = index.ravel()
            self.ones[d] = np.bincount(flat, (weight * self.bit).ravel(), len(found))
            self.zeros[d] = np.bincount(flat, weight.ravel(), len(found)) - self.ones[d]
            self.kt[d] = log_kt(self.zeros[d], self.ones[d])
            if d == DEPTH:
                self.weighted[d] = self.kt[d]
            else:
                parent = np.empty(len(self.weighted[d + 1]), np.int64)
                parent[self.at[d + 1].ravel()] = flat
                below = np.bincount(parent, self.weighted[d + 1], len(found))
                self.weighted[d] = _HALF + np.logaddexp(self.kt[d], below)

    def chance(self, d: int) -> np.ndarray:
        a, b = self.zeros[d][self.at[d]], self.ones[d][self.at[d]]
        return (np.where(self.bit == 1, b, a) + 0.5) / (a + b + 1)

    def stop(self, d: int) -> np.ndarray:
        return np.exp(_HALF + self.kt[d] - self.weighted[d])[self.at[d]]


def _pair_sums(table: pa.Table) -> pa.Table:
    keys, counts = (table.column(c).to_numpy() for c in ("key", "n"))
    out = []
    for k in range(8):
        tree = Subtree(keys, counts, range(k, k + 1))
        node = np.empty(len(tree.weighted[2]), np.int64)
        node[tree.at[2].ravel()] = tree.node.ravel()
        last = np.full(len(node), (keys[0] >> 8) & 255)
        out.append(pa.table({"last": last, "node": node, "zeros": tree.zeros[2], "ones": tree.ones[2], "weighted": tree.weighted[2]}))
    return pa.concat_tables(out)


def _top(rows: list) -> dict:
    """Estimates and weights of depths 1 and 0; at most 256 x 255 rows come in."""
    zeros, ones, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        zeros[r.last, r.node], ones[r.last, r.node], below[r.last, r.node] = r.zeros, r.ones, r.weighted
    kt1 = log_kt(zeros, ones)
    weighted1 = _HALF + np.logaddexp(kt1, below)
    kt0 = log_kt(zeros.sum(0), ones.sum(0))
    weighted0 = _HALF + np.logaddexp(kt0, weighted1.sum(0))
    half = lambda z, o: (o + 0.5) / (z + o + 1)
    return {"one1": half(zeros, ones), "stop1": np.exp(_HALF + kt1 - weighted1), "one0": half(zeros.sum(0), ones.sum(0)), "stop0": np.exp(_HALF + kt0 - weighted0)}


def string_scores(counts: DataFrame) -> DataFrame:
    """(key, n) of strings to (key, value): log10 of the last byte's probability after the other four."""
    pairs = counts.withColumn("pair", F.expr("(key >> 8) & 65535"))
    sums = pairs.groupBy("pair").applyInArrow(_pair_sums, "last long, node long, zeros double, ones double, weighted double")
    top = _top(sums.groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).collect())

    def run(table: pa.Table) -> pa.Table:
        keys, counts = table.column("key").to_numpy(), table.column("n").to_numpy()
        value = np.zeros(len(keys))
        for k in range(8):
            tree = Subtree(keys, counts, range(k, k + 1))
            p = tree.chance(DEPTH)
            for d in range(DEPTH - 1, 1, -1):
                w = tree.stop(d)
                p = w * tree.chance(d) + (1 - w) * p
            last = np.broadcast_to((keys >> 8) & 255, tree.node.shape)
            for one, stop in ((top["one1"][last, tree.node], top["stop1"][last, tree.node]), (top["one0"][tree.node], top["stop0"][tree.node])):
                p = stop * np.where(tree.bit == 1, one, 1 - one) + (1 - stop) * p
            value += np.log10(p)[0]
        return pa.table({"key": keys, "value": value})

    return pairs.groupBy("pair").applyInArrow(run, "key long, value double")


def score_documents(documents: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """Score every text with models learned from those whose ``crc32(doc_id) % folds`` is not ``fold``.

    Needs ``doc_id`` and ``text``; other columns are ignored.  Returns doc_id,
    held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (word unigram with add-one smoothing, log10), score
    (context-tree weighting, log10 of the probability of the bytes and the end) and
    bits_per_byte.  A null text is an empty one; a null id belongs to the training
    texts.  An empty table gives an empty result.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    docs = documents.select("doc_id", "text", held.alias("held_out"))
    counts = stored(training_counts(docs), "counts")
    train = counts.where("key < 0 and n > 0").agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = train[0] or 0, train[1]
    words = counts.where("key < 0 and n > 0").select("key", F.col("n").cast("double").alias("value"))
    values = stored(words.unionByName(string_scores(counts.where("key >= 0"))), "values")
    dropped(counts)

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows without an id, or of one id, are still dealt by their texts.
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(-(-total // CHUNK) or 1)).cast("int")
    dealt = docs.withColumn("chunk", chunk)

    def asked(table: pa.Table) -> pa.Table:
        found: list = [np.array([END_WORD], np.int64)]
        raw: list = []

        def settle() -> None:
            if raw:
                found.append(np.unique(np.concatenate(raw)))
                raw.clear()

        for part in table.select(["text"]).combine_chunks().to_batches(2000):
            data, offsets = text_bytes(part.column(0))
            for _, _, x, _ in grams(data, offsets):
                raw.append(x)
            for _, _, x, _ in word_hashes(part.column(0)):
                raw.append(word_keys(x))
            if sum(map(len, raw)) > 1 << 22:
                settle()
        settle()
        keys = np.unique(np.concatenate(found))
        return pa.table({"chunk": np.full(len(keys), table.column("chunk")[0].as_py(), np.int32), "key": keys})

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, value = answers.column("key").to_numpy(), answers.column("value").to_numpy()
        order = np.argsort(keys)
        keys, value = keys[order], value[order]
        known = np.append(keys, np.iinfo(np.int64).max)
        value = np.append(value, 0.0)

        def look(x: np.ndarray) -> np.ndarray:
            at = np.searchsorted(keys, x)
            return np.where(known[at] == x, value[at], 0.0)

        n = texts.num_rows
        log = lambda c: np.log10((c + 1) / (tokens + kinds + 1))
        end = float(look(np.array([END_WORD]))[0])
        base, score = np.full(n, log(end)), np.zeros(n)
        n_tokens, n_known, n_bytes = np.ones(n, np.int64), np.full(n, int(end > 0), np.int64), np.ones(n, np.int64)
        row = 0
        for part in texts.select(["text"]).combine_chunks().to_batches(2000):
            data, offsets = text_bytes(part.column(0))
            n_bytes[row : row + part.num_rows] += np.diff(offsets)
            for i, j, x, at in grams(data, offsets):
                score[row + i : row + j] += np.bincount(np.repeat(np.arange(j - i), np.diff(at)), look(x), j - i)
            for i, j, x, at in word_hashes(part.column(0)):
                c, own = look(word_keys(x)), np.repeat(np.arange(j - i), np.diff(at))
                base[row + i : row + j] += np.bincount(own, log(c), j - i)
                n_known[row + i : row + j] += np.bincount(own, c > 0, j - i).astype(np.int64)
                n_tokens[row + i : row + j] += np.diff(at)
            row += part.num_rows
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(n, tokens), "base_score": base, "score": score, "bits_per_byte": -score / np.log10(2) / n_bytes})

    requests = dealt.groupBy("chunk").applyInArrow(asked, "chunk int, key long")
    answers = requests.join(values, "key")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("chunk").cogroup(answers.select("chunk", "key", "value").groupBy("chunk")).applyInArrow(scored, out)
