"""N-gram Jaccard join: texts whose sets of word shingles overlap enough, as linked classes.

Method: size-banded tiles with hashed bitmap signatures.

* Sizes fall into bands such that two sets similar enough lie in one band or in
  neighbouring ones; a *tile* is a band with the one below it.
* Within a tile two linked sets differ in at most ``d`` elements.  Each set is
  dealt by hash into more than ``d`` parts, so linked sets agree in a whole part.
  The (tile, part, content of the part) is the join key: a phrase that thousands
  of texts share fills no whole part of theirs, so it brings no candidates.
  The parts are more than ``d`` by as many as a set may leave empty, a number that
  grows with the tile.  Sets with more empty parts are dealt again with another hash;
  what is left after the last deal is keyed by its first elements in a hashed order,
  of which linked sets share one.  Nothing is lost.
* Each set has a bitmap of 1024 parities.  Bits that differ between two bitmaps
  are a lower bound of the elements that differ, so they bound the overlap from above.
* What survives is decided by intersecting the sorted shingle arrays exactly.

Equal sets are one class from the start.  Candidates are first the pairs of each
key's smallest member with the others; only keys whose members are then still in
different components are compared member by member, so no group of copies is
expanded into all its pairs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, dropped, join_with_hot, mix, stored, word_hashes
from .graph import components

_U = np.uint64
BITMAP = [f"b{i}" for i in range(16)]
#: Pairs that may be broadcast: 32 bytes each, so 32 MB at most.  Above it the join shuffles.
BROADCAST_PAIRS = 1 << 20
_DEALS = 8
#: Where the numbers of texts without an id begin.
NAMELESS = 1 << 62
#: Tiles are dealt out in so many passes; what one has shuffled is deleted before the next.
PASSES = 2
#: Rounds in which open keys are compared with one member of their largest component, before all their members are.
ROUNDS = 3


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    runs = np.full(n - size + 1, size, np.uint64) * _U(0xA24BAED4963EE407)
    factor = 1
    for i in range(size):
        factor = factor * 0x9FB21C651E98DF25 % (1 << 64)
        runs += words[i : n - size + 1 + i] * _U(factor)
    return np.unique(mix(runs))


def bands(p: int, q: int) -> list[int]:
    """First size of each band: linked sets of different sizes lie in one band or in neighbouring ones."""
    at, starts = ceil(p / (q - p)), []
    while at < 1 << 40:
        starts.append(at)
        at = at * q // p + 1
    return starts


_PARTS: dict[tuple[int, int], tuple[int, int]] = {}


def tile_parts(low: int, most: int) -> tuple[int, int]:
    """Parts of a tile, and how many of them a set may leave empty: so many that most deals of its smallest sets do."""
    if (low, most) in _PARTS:
        return _PARTS[low, most]
    spare = 0
    while True:
        parts = most + 1 + spare
        empty = parts * (1 - 1 / parts) ** low
        spread = max(parts * (parts - 1) * (1 - 2 / parts) ** low + empty - empty * empty, 0.0) if parts > 1 else 0.0
        more = ceil(empty + sqrt(spread) - 0.5)
        if more <= spare or spare > most:
            _PARTS[low, most] = parts, spare
            return parts, spare
        spare = more


def part_keys(found: np.ndarray, starts: list[int], p: int, q: int, only: int | None = None) -> np.ndarray:
    """The join keys of a sorted set of hashes, in number at most in proportion to its size; ``only`` those of one pass."""
    band = bisect_right(starts, len(found)) - 1
    tiles = [] if band < 0 else [t for t in (band, band + 1) if only is None or t % PASSES == only]
    if not tiles:
        return np.empty(0, np.uint64)
    keys = []
    for tile in tiles:
        most = (q - p) * 2 * (starts[tile + 1] - 1) // (p + q)
        parts, spare = tile_parts(starts[max(tile - 1, 0)], most)
        for deal in range(_DEALS):
            own = found if deal == 0 else np.sort(mix(found + _U(deal * 0x9E3779B97F4A7C15 % (1 << 64))))
            part = ((own >> _U(32)) * _U(parts)) >> _U(32)
            bound = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own ^ _U(0x5851F42D4C957F2D)))])
            full = np.flatnonzero(bound[1:] > bound[:-1])
            label = mix(full.astype(np.uint64) + _U((tile << 40) + (deal << 36)))
            keys.append(mix(total[bound[full + 1]] - total[bound[full]] + label))
            if parts - len(full) <= spare:
                break
        else:
            least = -(-len(found) * p // q)
            first = np.sort(mix(found ^ _U(0x2545F4914F6CDD1D)))[: len(found) - least + 1]
            keys.append(mix(first + _U((tile << 40) + (1 << 39))))
    return np.concatenate(keys)


def _bitmap(found: np.ndarray) -> np.ndarray:
    counts = np.bincount((mix(found ^ _U(0x2127599BF4325C37)) >> _U(54)).astype(np.int64), minlength=1024)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def _set_hashes(found: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set."""
    return tuple(int(mix(found ^ _U(c)).sum(dtype=np.uint64).view(np.int64)) for c in (0x1B873593CC9E2D51, 0x71D67FFFEDA60000))


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """Per text: set size, a 128-bit hash of the set and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, at in word_hashes(batch.column(1)):
                rows = []
                for k in range(j - i):
                    found = shingles(words[at[k] : at[k + 1]], size)
                    rows.append(np.concatenate([np.array([len(found), *_set_hashes(found)], np.int64), _bitmap(found)]))
                table = np.stack(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(table[:, c]) for c in range(table.shape[1]))], ["doc_id", "n", "fa", "fb", *BITMAP])

    return docs.mapInArrow(run, "doc_id long, n long, fa long, fb long, " + ", ".join(f"{b} long" for b in BITMAP))


def key_rows(docs: DataFrame, size: int, p: int, q: int, only: int | None = None) -> DataFrame:
    """The join keys of every set, or those of one pass, beside the set's hash; a task hands on equal sets once as far as it remembers."""
    starts = bands(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for i, j, words, at in word_hashes(batch.column(1)):
                keys, sets = [], []
                for k in range(j - i):
                    found = shingles(words[at[k] : at[k + 1]], size)
                    if len(found) < starts[0]:
                        continue
                    fa, _ = _set_hashes(found)
                    if fa in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(fa)
                    keys.append(part_keys(found, starts, p, q, only).view(np.int64))
                    sets.append(np.full(len(keys[-1]), fa, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sets))], ["key", "fa"])

    return docs.mapInArrow(run, "key long, fa long")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """Columns of ``docs`` with the last one, the text, replaced by its sorted array of distinct shingle hashes."""
    kept = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, at in word_hashes(batch.column(len(kept))):
                sets = [shingles(words[at[k] : at[k + 1]], size).view(np.int64) for k in range(j - i)]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(kept))), listed], [*kept, "shingles"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in kept) + ", shingles array<long>")


def shared_size(a: Column, b: Column) -> Column:
    """How many elements two sorted arrays of distinct numbers share: one merge for each pair."""

    @F.arrow_udf("long")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), np.int64)
        x, y = np.array(left.flatten()).view(np.uint64), np.array(right.flatten()).view(np.uint64)
        i = np.concatenate([[0], np.cumsum(np.array(left.value_lengths(), np.int64))]).tolist()
        j = np.concatenate([[0], np.cumsum(np.array(right.value_lengths(), np.int64))]).tolist()
        for k in range(len(out)):
            both = np.concatenate([x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]])
            both.sort(kind="stable")  # two sorted runs: a merge
            out[k] = (both[1:] == both[:-1]).sum()
        return pa.array(out)

    return run(a, b)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, p: int, q: int) -> DataFrame:
    """Of candidate ``pairs(a, b, na, nb)``, those that link by exact intersection."""
    pairs = stored(pairs, "pairs")
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else lambda df: df
    # Sets of the members travel once, to their pair's other end; of that end only once per text.
    members = docs.join(few(pairs), docs["doc_id"] == pairs["b"]).select("a", "b", "na", "nb", "text")
    centres = docs.join(few(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", "text")
    sets = shingle_sets(centres, size).select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    both = shingle_sets(members, size).join(sets, "a")
    shared = shared_size(F.col("shingles"), F.col("sa"))
    found = stored(both.select("a", "b", (shared * q >= (F.col("na") + F.col("nb") - shared) * p).alias("linked")).where("linked").select("a", "b"), "links")
    dropped(pairs)
    return found


def jaccard_classes(documents: DataFrame, size: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """Link texts whose shingle sets have ``q * intersection >= p * union``; one row per document.

    ``documents`` needs ``doc_id`` (unique, below 2 ** 62) and ``text``; other columns are ignored.
    Returns (doc_id, n_shingles, component_id): the set's size and the smallest
    doc_id reachable by links, itself included.  A text of fewer than ``size``
    words is one shingle; a null text or one without words has none and links
    with nothing, so it is its own component.  Repeated texts link.  A document
    without an id links as others do; its component is null if no document in it has an
    id.  An empty table gives an empty result.
    """
    # Texts without an id go by a number after all ids.
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("text"), F.lit(NAMELESS >> 1))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc_id"), "text")
    prof = stored(profiles(docs, size), "profiles")
    classes = stored(prof.where("n > 0").groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.min(b).alias(b) for b in BITMAP)), "classes")

    # Most keys are one set's own.  A set has a tile of either parity, so a pass shuffles about half of the keys.
    spread = "PARTITION BY key"
    passes = []
    for only in range(PASSES):
        rows = key_rows(docs, size, p, q, only)
        passes.append(stored(rows.selectExpr("key", "fa", f"min(fa) OVER ({spread}) AS low", f"max(fa) OVER ({spread}) AS high").where("low <> high").select("key", "low", "fa").distinct(), "shared"))
    shared = reduce(DataFrame.union, passes)
    known = stored(classes.join(shared.select("fa").distinct(), "fa"), "known")

    def side(name: str) -> DataFrame:
        return known.select(F.col("fa").alias(f"f{name}"), F.col("rep").alias(name), F.col("n").alias(f"n{name}"), *(F.col(b).alias(f"{b}{name}") for b in BITMAP))

    apart = reduce(add, (F.bit_count(F.col(f"{b}a").bitwiseXOR(F.col(f"{b}b"))) for b in BITMAP))
    could = (F.col("a") != F.col("b")) & (apart * (p + q) <= (F.col("na") + F.col("nb")) * (q - p)) & (F.least("na", "nb") * q >= F.greatest("na", "nb") * p)
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")]

    stars = shared.where("fa <> low").groupBy(F.col("low").alias("fp"), F.col("fa").alias("fq")).agg(F.count("*").alias("votes"))
    stars = stars.join(side("a").withColumnRenamed("fa", "fp"), "fp").join(side("b").withColumnRenamed("fb", "fq"), "fq").where(could)
    stars = stored(stars.select(*ordered, "votes", F.col("b").alias("member")), "stars")

    best = stars.groupBy("member").agg(F.max_by(F.struct("a", "b", "na", "nb"), F.struct("votes", "a", "b")).alias("top")).select("top.*").distinct()
    links = _verified(best, docs, size, p, q)
    found = components(links)
    dropped(links)

    def labelled(df: DataFrame, column: str, label: str) -> DataFrame:
        named = found.select(F.col("node").alias(column), F.col("component").alias(label))
        return df.join(named, column, "left").withColumn(label, F.coalesce(label, column))

    def merged(links: DataFrame) -> DataFrame:
        """Components after more links, found on the graph whose nodes are the components so far; drops both inputs."""
        joint = components(labelled(labelled(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        named = joint.select(F.col("node").alias("component"), F.col("component").alias("new"))
        old = found.join(named, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        out = stored(old.union(joint.join(found.select("node"), "node", "left_anti")), "comp")
        dropped(joint, links, found)
        return out

    rest = stars.select("a", "b", "na", "nb").distinct().join(best.select("a", "b"), ["a", "b"], "left_anti")
    rest = labelled(labelled(rest, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b", "na", "nb")
    found = merged(_verified(rest, docs, size, p, q))

    def open_members() -> DataFrame:
        """Members of the keys whose members are still in different components."""
        member = labelled(shared.join(known.select("fa", "rep"), "fa").select("key", "rep"), "rep", "c")
        split = member.groupBy("key").agg(F.min("c").alias("l"), F.max("c").alias("h")).where("l < h").select("key")
        return stored(member.join(split, "key").distinct(), "open")

    # Each open key's largest component names one member, another one in every round, that the
    # other components' members are compared with: two pairs' worth of rows for each member.
    done, turns = stars.select("a", "b"), []
    open_rows = open_members()
    for turn in range(ROUNDS):
        if open_rows.isEmpty():
            break
        parts = open_rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("centre"))
        centres = parts.groupBy("key").agg(F.max_by(F.struct("c", "centre"), F.struct("n", "c")).alias("t")).select("key", F.col("t.c").alias("ca"), F.col("t.centre").alias("a"))
        pairs = open_rows.select("key", F.col("rep").alias("b"), F.col("c").alias("cb")).join(centres, "key").where("ca <> cb").select("a", "b").distinct()
        pairs = pairs.join(side("a").drop("fa"), "a").join(side("b").drop("fb"), "b").where(could).select(*ordered).distinct()
        pairs = stored(pairs.join(done, ["a", "b"], "left_anti"), "turn")
        turns.append(pairs)
        links = _verified(pairs, docs, size, p, q)
        done = done.union(pairs.select("a", "b"))
        if links.isEmpty():
            dropped(links)
            break
        found = merged(links)
        dropped(open_rows)
        open_rows = open_members()

    # What is still open is compared member by member.
    near = could & (F.col("ca") < F.col("cb"))
    left = open_rows.select("key", F.col("rep").alias("a"), F.col("c").alias("ca")).join(side("a").drop("fa"), "a")
    right = open_rows.select("key", F.col("rep").alias("b"), F.col("c").alias("cb")).join(side("b").drop("fb"), "b")
    cross = left.join(right, (left["key"] == right["key"]) & near).select(*ordered).distinct()
    cross = stored(cross.join(done, ["a", "b"], "left_anti"), "cross")
    found = merged(_verified(cross, docs, size, p, q))
    dropped(stars, open_rows, cross, known, *passes, *turns)

    named = classes.select("fa", "fb", "n", "rep", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("fa", "fb", "n", "copies", F.coalesce("component", "rep").alias("class"))
    # A text that many documents have meets its class where the documents are.
    hot = stored(named.where(F.col("copies") > max(1.0, prof.count() * HOT)).select("fa", "fb", "n"), "hot")
    out = join_with_hot(prof.where("n > 0").select("doc_id", "n", "fa", "fb"), named.drop("copies"), ["fa", "fb", "n"], hot, "left")
    empty = prof.where("n = 0").select("n", "doc_id", F.col("doc_id").alias("class"))
    out = out.select("n", "doc_id", "class").union(empty)
    named = lambda c: F.when(c < NAMELESS, c)
    return out.select(named(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), named(F.coalesce("class", "doc_id")).alias("component_id"))
