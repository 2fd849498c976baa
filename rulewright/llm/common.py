"""Joins that split hot keys, and vectorised hashing of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, shared_dir, stored  # noqa: F401  (handed on to the other modules)

#: A word: a longest run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: A key is hot if it has more than this part of all rows: there are fewer than its inverse of them.
HOT = 1 / 2000


def hot_keys(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Keys of more than ``HOT`` of all rows, so fewer than 2,000 of them; counts combine before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(1.0, total * HOT)).drop("_n")


def join_with_hot(rows: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner", most: int = 200_000) -> DataFrame:
    """``rows`` joined with ``side`` on ``keys``; rows of hot keys meet a broadcast copy of the side's rows and are not moved.

    ``hot`` comes from ``hot_keys`` and is stored.  If the side has more than ``most``
    rows of hot keys, its part is not broadcast but shuffled.
    """
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    part = side.join(F.broadcast(hot), keys, "left_semi")
    part = F.broadcast(part) if part.limit(most + 1).count() <= most else part
    away = marked.where("_hot").drop("_hot").join(part, keys, how)
    return away.unionByName(marked.where("_hot is null").drop("_hot").join(side, keys, how))


# --- hashing -----------------------------------------------------------------

_U = np.uint64
GAMMA = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _tables() -> dict:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _U(GAMMA))
    return {"lower": lower, "code": codes[lower], "word": ~space}


_T = _tables()
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base ** i and its inverse modulo 2 ** 64, for i below ``n`` at least."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, _CHUNK + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _hash_flat(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of texts laid end to end; a text's start ends the word before."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _powers(len(data) + 1)
    inside = _T["word"][data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = starts[starts < len(data)]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_T["code"][data] * up[: len(data)], out=total[1:])
    value = (total[end + 1] - total[begin]) * down[begin]
    return mix(value + (end - begin + 1).astype(np.uint64) * _U(GAMMA)), begin


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about a megabyte, cut at white space where there is some."""
    at = 0
    while len(data) - at > _CHUNK:
        gaps = np.flatnonzero(~_T["word"][data[at + _CHUNK // 2 : at + _CHUNK]])
        step = _CHUNK // 2 + gaps[-1] if len(gaps) else None
        if step is None:
            rest = np.flatnonzero(~_T["word"][data[at + _CHUNK :]])
            step = _CHUNK + (rest[0] if len(rest) else len(data) - at - _CHUNK)
        yield data[at : at + step]
        at += step
    yield data[at:]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end (null as empty), and where each row starts and ends."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups_of_rows(offsets: np.ndarray, limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, end row, hashes of their lower-cased words, words before each row."""
    data, offsets = text_bytes(column)
    for i, j in groups_of_rows(offsets):
        part = data[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > _CHUNK:
            hashes = np.concatenate([_hash_flat(p, np.zeros(1, np.int64))[0] for p in _pieces(part)])
            yield i, j, hashes, np.array([0, len(hashes)])
        else:
            own = offsets[i : j + 1] - offsets[i]
            hashes, begin = _hash_flat(part, own[:-1])
            yield i, j, hashes, np.searchsorted(begin, own)
