"""URL filters: a temporal join of captures with dated list entries.

List entries say from when on a host or a host's first path part is blocked,
allowed or off the list.  Consecutive entries of one key become validity
intervals; every capture is judged by the entries that were valid when it was
fetched, the most specific key first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT, hot_keys, join_with_hot, stored

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PART = r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^/?#]+)"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def list_keys(url: Column) -> Column:
    """What entries can name: the host, its parent domains of two labels or more, and the host with its first path part."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    parents = F.when(count > 2, F.transform(F.sequence(F.lit(1), count - 1), lambda i: F.array_join(F.slice(labels, i, count), "."))).otherwise(F.array(host))
    part = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), PART, 1)
    return F.when(host == "", F.array().cast("array<string>")).when(part == "", parents).otherwise(F.concat(parents, F.array(F.concat(host, part))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``entries(key, action, listed_at)`` as (key, action, valid_from, valid_to).

    An entry is valid until the next one of its key; action ``off`` only ends the
    one before.  Of entries with the same key and time the greatest action by name
    counts.  Entries without key, action or time are left out.  valid_to is null
    for the last entry of a key.
    """
    clean = entries.where("key is not null and action is not null and listed_at is not null").groupBy("key", "listed_at").agg(F.max("action").alias("action"))
    line = W.partitionBy("key").orderBy("listed_at")
    return clean.select("key", "action", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(line).alias("valid_to")).where("action <> 'off'")


def judge_captures(captures: DataFrame, intervals: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with verdict, list_key, valid_from and valid_to of the entry that decides.

    The longest key valid at the time of the fetch decides; a key has one valid
    entry at any time, so no group is multiplied.  Captures of a host that many have
    meet a broadcast copy of that host's entries.  Without a valid entry, without a
    host or without a time the verdict is ``unlisted``.  Each distinct (url, time) is
    judged once and joined back, so repeated rows stay repeated.  Columns named
    like a result are replaced.
    """
    rows = captures.drop("verdict", "list_key", "valid_from", "valid_to")
    kept = rows.columns
    rows = rows.select(F.struct(*kept).alias("_row"), F.col(url).alias("u"), F.col(fetched_at).alias("t"))
    asked = rows.where("u is not null and t is not null").groupBy("u", "t").agg(F.count("*").alias("_times"))
    keys = stored(asked.withColumn("key", F.explode_outer(list_keys(F.col("u")))), "keys")
    size = keys.agg(F.count("*").alias("n"), F.sum("_times").alias("rows")).first()
    hot = stored(hot_keys(keys.where("key is not null").select("key"), ["key"], size.n), "hot")
    times = keys.select("u", "t", "_times").where(F.col("_times") > max(1.0, (size.rows or 0) * HOT)).distinct()
    both = join_with_hot(keys.where("key is not null").select("key", "u", "t"), intervals, ["key"], hot)
    both = both.where((F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
    entry = F.struct(F.length("key").alias("n"), F.col("key").alias("list_key"), F.col("action").alias("verdict"), "valid_from", "valid_to")
    best = stored(both.groupBy("u", "t").agg(F.max(entry).alias("e")).select("u", "t", "e.verdict", "e.list_key", "e.valid_from", "e.valid_to"), "judged")
    out = join_with_hot(rows, best, ["u", "t"], stored(times.select("u", "t"), "hot"), "left")
    return out.select(*(F.col("_row").getField(c).alias(c) for c in kept), F.coalesce("verdict", F.lit("unlisted")).alias("verdict"), "list_key", "valid_from", "valid_to")
