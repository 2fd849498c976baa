"""Spelling variants by a dictionary of trie-node pairs.

Every distinct beginning of a word is a node of a trie, every distinct ending a node
of the trie of reversed words, and both get integer numbers.  A word of length L has
a pair (node of the first i letters, node of the last L - i - 1) for each letter that
is skipped and a pair (first i, last L - i) for each place between letters.  Two words
that differ by one replaced letter share a skipped pair; a word with one letter more
shares its skipped pair with a place pair of the shorter one.  Numbers are exact, so
equal pairs are neighbours without any check, and a pair's words differ in one letter
at most: there are never more of them than letters in the alphabet, and one.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, stored

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that one task numbers, about.
PART = 50_000
#: Numbers of a part's own nodes and words begin at its index times this.
SPAN = 1 << 40


def spelled_words(documents: DataFrame, least: int = 7, text: str = "text", ident: str = "doc_id", slip: int = 31) -> DataFrame:
    """Words (word, n) of at least ``least`` letters with the number of times they occur.

    Runs of letters of whole texts, A-Z lower-cased.  With h the crc32 of
    ``ident:run``, a run whose h is divisible by ``slip`` loses its letter h modulo
    length, so that corpora without typing errors have some.  A null id counts as an
    empty one, a null text has no words.  Counts combine before the shuffle.
    """
    # A longest run of at least so many letters is taken whole; shorter ones lose nothing that counts.
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    runs = documents.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("d"), run.alias("r"))
    runs = runs.select("d", F.translate("r", UPPER, LOWER).alias("r")).select("r", F.crc32(F.concat("d", F.lit(":"), "r")).alias("h"))
    at = (F.col("h") % F.length("r")).cast("int")
    slipped = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))
    word = F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("r"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _common(a: str, b: str) -> int:
    """How many letters two words have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _shared_nodes(bounds: list) -> dict[int, tuple[list[int], list[int], str]]:
    """Numbers of the nodes that lie in several parts, from each part's first and last word.

    Per part: numbers for the first word's beginnings that the part before has too, and
    for those of the last word that the next part has.  They are negative.
    """
    out, chain, made = {}, [], 0
    for k, now in enumerate(bounds):
        head = list(chain)
        del chain[_common(now.first, now.last) + 1 :]
        if k + 1 < len(bounds):
            for _ in range(len(chain), _common(now.last, bounds[k + 1].first) + 1):
                made += 1
                chain.append(-made)
            del chain[_common(now.last, bounds[k + 1].first) + 1 :]
        else:
            chain = []
        out[now.part] = (head, list(chain), now.last)
    return out


def _number(words: list[str], part: int, head: list[int], tail: list[int], last: str) -> tuple[list[int], list[int]]:
    """Nodes of all beginnings of sorted words, the empty one first, end to end; and how many each word has."""
    flat, sizes, made = [], [], part * SPAN
    path, before = list(head), words[0] if words else ""
    known = len(head) - 1 if head else -1
    for k, word in enumerate(words):
        keep = known if k == 0 else _common(before, word)
        del path[keep + 1 :]
        same = _common(word, last) if len(tail) > len(path) else -1
        for i in range(len(path), len(word) + 1):
            if i < len(tail) and i <= same:
                path.append(tail[i])
            else:
                made += 1
                path.append(made)
        flat += path
        sizes.append(len(path))
        before = word
    return flat, sizes


def numbered(words: DataFrame, key: str, nodes: str, name: str) -> DataFrame:
    """``words`` with ``ident``, a number in order of the distinct texts ``key``, and the nodes of all beginnings of ``key``.

    Words are dealt out by ranges; inside one a task walks them in order and opens a
    node wherever a word leaves the one before.  Only first and last words of ranges go
    to the driver, which settles the nodes that cross from one range to the next.
    The result is stored; the caller drops it.
    """
    parts = max(1, -(-words.count() // PART))
    ranged = stored(words.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    bounds = ranged.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last")).withColumnRenamed("_part", "part").collect()
    shared = _shared_nodes(sorted(bounds, key=lambda r: r.part))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in words.schema]

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        part = table["_part"][0].as_py()
        flat, sizes = _number(table[key].to_pylist(), part, *shared[part])
        lists = pa.LargeListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int64()), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))
        idents = pa.array(np.arange(len(sizes), dtype=np.int64) + part * SPAN)
        return table.drop_columns(["_part"]).append_column("_ident", idents).append_column(nodes, lists)

    out = stored(ranged.groupBy("_part").applyInArrow(number, ", ".join([*fields, "_ident long", f"{nodes} array<long>"])), name)
    dropped(ranged)
    return out


def _pairs(both: DataFrame) -> DataFrame:
    """Node pairs of every word: role 0 for a place, 1 for a skipped letter, 2 if the letter before is another one.

    Leaving out either of two equal neighbouring letters gives the same word, so only
    the first of a run counts there.
    """
    size = F.size("pre") - 1

    def skip(i: Column) -> Column:
        role = F.when(F.get("opens", i), 2).otherwise(1)
        return F.struct(F.get("pre", i).alias("p"), F.get("suf", size - 1 - i).alias("s"), role.alias("role"))

    def place(i: Column) -> Column:
        return F.struct(F.get("pre", i).alias("p"), F.get("suf", size - i).alias("s"), F.lit(0).alias("role"))

    made = F.concat(F.transform(F.sequence(F.lit(0), size - 1), skip), F.transform(F.sequence(F.lit(0), size), place))
    return both.select("ident", "n", F.inline(made))


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary(ident, word, n), near(ident, n_near, best_n, best)) of distinct words (word, n); ``ident`` follows the words' order.

    ``best`` is the near word of the largest n, of equal ones the first.  Words
    without near ones are left out of the second table.  Both are stored.
    """
    words = words.where("word <> ''")
    letters = F.split("word", "")
    fore = numbered(words, "word", "pre", "fore")
    back = numbered(fore.select(F.reverse("word").alias("drow"), F.col("_ident").alias("ident")), "drow", "suf", "back")
    opens = F.transform(F.arrays_zip(letters.alias("c"), F.concat(F.array(F.lit("")), letters).alias("b")), lambda z: z["c"] != z["b"])
    both = fore.withColumnRenamed("_ident", "ident").withColumn("opens", opens).join(back.select("ident", "suf"), "ident")
    found = _pairs(both)
    pair = W.partitionBy("p", "s")
    order = pair.orderBy(F.desc("n"), "ident").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    me = F.struct("n", "ident")
    first, second = F.first(me).over(order), F.nth_value(me, 2).over(order)
    other = F.when(first["ident"] == F.col("ident"), second).otherwise(first)
    skips, opened, places = (F.count(F.when(F.col("role").isin(r), 1)).over(order) for r in ([1, 2], [2], [0]))
    leader = F.first(F.when(F.col("role") == 2, me), ignorenulls=True).over(order)
    near = F.when(F.col("role") == 0, opened).otherwise(skips - 1 + F.when(F.col("role") == 2, places).otherwise(0))
    # A place pair's other words are those with a letter more; a skipped pair's are all others.
    rows = found.withColumn("near", near).withColumn("other", F.when(F.col("role") == 0, leader).otherwise(other)).where("near > 0")
    total = rows.select("ident", "near", F.struct(F.col("other.n").alias("n"), (-F.col("other.ident")).alias("less")).alias("o")).groupBy("ident").agg(F.sum("near").alias("n_near"), F.max("o").alias("o"))
    out = stored(total.select("ident", "n_near", F.col("o.n").alias("best_n"), (-F.col("o.less")).alias("best")), "near")
    slim = fore.select(F.col("_ident").alias("ident"), "word", "n")
    slim._stored_at = fore._stored_at
    dropped(back)
    return slim, out


def last_forms(links: DataFrame) -> DataFrame:
    """Where following links(ident, form) ends: (ident, root).  Every round doubles the steps; n grows along a chain, so it ends."""
    now = stored(links.select("ident", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("ident").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(ahead, "root", "left").select("ident", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        dropped(now)
        now = after
        if not moved:
            return now


def variant_groups(documents: DataFrame, least: int = 7, often: int = 2, ratio: int = 10, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Words of the documents with their usual spelling: (word, n, n_near, form, form_n, root).

    ``n_near`` counts the words one inserted, deleted or replaced letter away; ``form``
    is the one of them with the largest n (ties: the first in code-point order) if it
    occurs at least ``ratio`` times as often; ``root`` is where forms lead.  Words are
    those of at least ``least`` letters that occur ``often`` times or more.  Repeated rows count as often
    as they stand there; an empty table and texts without words give no rows.
    """
    words = stored(spelled_words(documents, least, text, ident).where(F.col("n") >= often), "words")
    known, near = near_words(words)
    usual = near.join(known.select("ident", "n"), "ident").select("ident", "n_near", F.when(F.col("best_n") >= F.col("n") * ratio, F.col("best")).alias("form"), F.col("best_n").alias("form_n"))
    usual = stored(usual, "usual")
    roots = last_forms(usual.where("form is not null").select("ident", "form"))
    names = known.select(F.col("ident").alias("form"), F.col("word").alias("form_word"))
    last = known.select(F.col("ident").alias("root"), F.col("word").alias("root_word"))
    told = usual.where("form is not null").select("ident", "form", "form_n").join(roots.select("ident", "root"), "ident").join(names, "form").join(last, "root").select("ident", "form_word", "form_n", "root_word")
    out = known.join(usual.select("ident", "n_near"), "ident", "left").join(told, "ident", "left")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root")), "variants")
    dropped(words, known, near, usual, roots)
    return out
