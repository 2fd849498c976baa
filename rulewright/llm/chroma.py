"""Media columns: chroma fingerprints of audio, and their alignment.

A WAV column becomes frames of energy per pitch class.  Box filters over an
integral image of the frames give, for every position, sixteen values that are
cut into four levels each and packed into one 32-bit integer.  Recordings are
aligned by the histogram of offsets between equal integers; at the best offset the
share of differing bits says how alike they are.

Recordings with equal fingerprints are one class; classes, not recordings, are
aligned, so a large group of copies brings no pairs.  The asked classes go in blocks
of bounded size past all classes: an integer that most recordings share (silence, a
steady tone) then costs arithmetic inside tasks, but no shuffled pairs.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FRAME, HOP, SPAN = 1024, 256, 16
#: Box filters: kind, first pitch class, pitch classes high, frames wide; a rule spreads them over the image.
FILTERS = [(k % 4, (5 * k) % 12, 1 + k % 5, 4 + 4 * (k % 4)) for k in range(16)]
#: Cuts of the logarithmic contrast of a filter's two halves, and the two bits of each level (neighbours differ in one).
CUTS = (-0.15, 0.0, 0.15)
GRAY = (0, 1, 3, 2)


def read_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 and their rate; nothing for what is no PCM WAV of 8, 16 or 32 bits."""
    try:
        with wave.open(io.BytesIO(raw)) as w:
            width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            frames = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.empty(0), 1
    kind = {1: np.uint8, 2: np.int16, 4: np.int32}.get(width)
    if kind is None:
        return np.empty(0), 1
    x = np.frombuffer(frames[: len(frames) // (width * channels) * width * channels], kind).astype(float)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


_TABLES: dict[int, np.ndarray] = {}


def _pitch_classes(rate: int) -> np.ndarray:
    """Which of the 12 pitch classes each FFT bin between 55 and 1760 Hz adds to; the last rates' tables are kept."""
    if rate in _TABLES:
        return _TABLES[rate]
    if len(_TABLES) > 16:
        _TABLES.clear()
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(hertz), 12), np.float32)
    used = np.flatnonzero((hertz >= 55) & (hertz <= 1760))
    out[used, np.round(12 * np.log2(hertz[used] / 440)).astype(int) % 12] = 1
    _TABLES[rate] = out
    return out


def chroma_frames(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy of each pitch class in each frame, as parts of the frame's energy."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    tables, out = _pitch_classes(rate), []
    window = np.hanning(FRAME)
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(views), 512):  # long recordings in parts
        power = np.abs(np.fft.rfft(views[at : at + 512] * window, axis=1)) ** 2
        out.append(power @ tables)
    frames = np.concatenate(out)
    return frames / np.maximum(frames.sum(1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """One 32-bit integer for each position that has SPAN frames after it."""
    frames = chroma_frames(samples, rate)
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.empty(0, np.int32)
    wide = np.concatenate([frames, frames[:, :6]], 1)  # pitch classes go round
    image = np.zeros((wide.shape[0] + 1, wide.shape[1] + 1))
    image[1:, 1:] = wide.cumsum(0).cumsum(1)
    start = np.arange(n)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[start + t1, p1] - image[start + t0, p1] - image[start + t1, p0] + image[start + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, low, high, width in FILTERS:
        half, middle = width // 2, low + (high + 1) // 2
        if kind == 0:  # later half against the earlier one
            a, b = box(half, width, low, low + high), box(0, half, low, low + high)
        elif kind == 1:  # upper half against the lower one
            a, b = box(0, width, middle, low + high + 1), box(0, width, low, middle)
        elif kind == 2:  # opposite corners
            a = box(0, half, low, middle) + box(half, width, middle, low + high + 1)
            b = box(half, width, low, middle) + box(0, half, middle, low + high + 1)
        else:  # the middle third against its surroundings
            third = width // 3
            a = box(third, width - third, low, low + high)
            b = box(0, width, low, low + high) - a
        contrast = np.log((0.05 + np.maximum(a, 0)) / (0.05 + np.maximum(b, 0)))
        out = out << np.uint32(2) | np.array(GRAY, np.uint32)[np.searchsorted(CUTS, contrast)]
    return out.view(np.int32)


#: Integers of asked classes in a block: 8 MB.
BLOCK = 2 << 20
#: Equal integers of a block and of other recordings that are counted at once.
HITS = 2 << 20
MATCHES = "a long, b long, offset int, n int, bit_errors double"


def _print_lists(prints: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in prints])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*prints, np.empty(0, np.int32)]), pa.int32()))


def fingerprints(wav: Column) -> Column:
    """Fingerprint of a WAV column as array<int>; null, too short or unreadable audio has an empty one."""

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            raw = (column[k].as_py() for k in range(len(column)))
            yield _print_lists([fingerprint(*read_wav(x)) if x else np.empty(0, np.int32) for x in raw])

    return run(wav)


def tone_samples(levels: list | None, rate: int, seconds: float) -> np.ndarray:
    """Each number as a tone: its size gives the pitch, two octaves about 440 Hz; null and NaN count as 0."""
    x = np.nan_to_num(np.array([v or 0.0 for v in levels or []]))
    x = x / (np.abs(x).max() or 1) if len(x) else x
    pitch = 440 * 2 ** (np.round(12 * x) / 12)
    return (0.5 * np.sin(2 * np.pi * pitch[:, None] * (np.arange(int(rate * seconds)) / rate))).ravel()


def tones(levels: Column, rate: int = 4000, seconds: float = 0.1) -> Column:
    """A WAV recording that plays each number of an array as a tone."""

    @F.arrow_udf("binary")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([write_wav(tone_samples(column[k].as_py(), rate, seconds), rate) for k in range(len(column))], pa.binary())

    return run(levels)


def tone_prints(levels: Column, rate: int = 4000, seconds: float = 0.1) -> Column:
    """``fingerprints(tones(levels))`` without a column of recordings: each is written, read and dropped at once."""

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = (column[k].as_py() for k in range(len(column)))
            yield _print_lists([fingerprint(*read_wav(write_wav(tone_samples(x, rate, seconds), rate))) for x in rows])

    return run(levels)


def _runs(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where a run of equal integers begins in prints laid end to end: a steady sound counts once."""
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[starts[starts < len(flat)]] = True
    return np.flatnonzero(first)


class AskedBlock:
    """Some asked prints, ready to be looked up by value."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]) -> None:
        self.ids, self.prints = np.array(ids, np.int64), prints
        starts = np.concatenate([[0], np.cumsum([len(x) for x in prints])])
        flat = np.concatenate(prints)
        at = _runs(flat, starts[:-1])
        row = np.searchsorted(starts, at, "right") - 1
        order = np.argsort(flat[at], kind="stable")
        self.row, self.place = row[order].astype(np.int32), (at - starts[row])[order].astype(np.int32)
        self.values, self.first = np.unique(flat[at][order], return_index=True)
        self.count = np.diff(np.append(self.first, len(order)))

    def matches(self, ids: np.ndarray, flat: np.ndarray, starts: np.ndarray, votes: int, errors: float) -> Iterator[tuple]:
        """(asked, other, offset, votes, bit errors) of the other prints, laid end to end, that match."""
        at = _runs(flat, starts[:-1])
        k = np.searchsorted(self.values, flat[at]).clip(0, len(self.values) - 1)
        met = self.values[k] == flat[at]
        at, k = at[met], k[met]
        other = np.searchsorted(starts, at, "right") - 1
        hits = np.concatenate([[0], np.cumsum(self.count[k])])
        i = 0
        while i < len(at):
            # As many whole prints as bring about HITS equal integers, one at least.
            j = int(np.searchsorted(hits, hits[i] + HITS, "right")) - 1
            j = len(at) if j >= len(at) else int(np.searchsorted(other, other[j], "left"))
            if j <= i:
                j = int(np.searchsorted(other, other[i], "right"))
            n = self.count[k[i:j]]
            source = np.repeat(np.arange(i, j), n)
            slot = np.repeat(self.first[k[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a, b = self.row[slot].astype(np.int64), other[source].astype(np.int64)
            offset = self.place[slot] - (at[source] - starts[b])
            keep = self.ids[a] != ids[b]
            yield from self._best(a[keep], b[keep], offset[keep], ids, flat, starts, votes, errors)
            i = j

    def _best(self, a, b, offset, ids, flat, starts, votes, errors) -> Iterator[tuple]:
        order = np.lexsort((offset, b, a))
        a, b, offset = a[order], b[order], offset[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (offset[1:] != offset[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(a)))
        first, n = first[n >= votes], n[n >= votes]
        a, b, offset = a[first], b[first], offset[first]
        # Of one pair's offsets: most votes, then the smallest shift, then the greater one.
        order = np.lexsort((offset, -np.abs(offset), n, b, a))
        a, b, offset, n = a[order], b[order], offset[order], n[order]
        last = np.ones(len(a), bool)
        last[:-1] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        for x, y, shift, count in zip(a[last].tolist(), b[last].tolist(), offset[last].tolist(), n[last].tolist()):
            p, q = self.prints[x], flat[starts[y] : starts[y + 1]]
            low, high = max(0, shift), min(len(p), len(q) + shift)
            wrong = int(np.bitwise_count((p[low:high] ^ q[low - shift : high - shift]).view(np.uint32)).sum()) / ((high - low) * 32)
            if wrong <= errors:
                yield int(self.ids[x]), int(ids[y]), shift, count, wrong


def _block_matches(classes: DataFrame, ids: list[int], prints: list[np.ndarray], votes: int, errors: float) -> DataFrame:
    """Matches of one block with all classes(class, print)."""
    shared = classes.sparkSession.sparkContext.broadcast((ids, prints))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = AskedBlock(*shared.value)
        names = ["a", "b", "offset", "n", "bit_errors"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        for batch in batches:
            lists = batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths(), np.int64))])
            found = list(block.matches(np.array(batch.column(0)), np.array(lists.flatten()), bounds, votes, errors))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    out = stored(classes.select("class", "print").mapInArrow(run, MATCHES), "matches")
    shared.unpersist()
    return out


def align_recordings(prints: DataFrame, queries: Column, ident: str = "id", votes: int = 4, errors: float = 0.35) -> DataFrame:
    """Align recordings that ``queries`` selects with all others by ``prints(ident, print)``.

    One row per recording: ident, class_id (smallest id with an equal fingerprint),
    n_prints, queried, n_matches, best_match, offset (frames to add to the match's
    position) and bit_errors.  Two classes match if at one offset at least
    ``votes`` runs of equal integers meet and at most ``errors`` of the bits of
    their overlap differ; a class is a query if one of its recordings is.  Matches
    name classes, so a group of copies is one match.  An empty or null fingerprint is
    a class of its own for each recording and matches nothing.  Every integer counts,
    however common.  Repeated ids are rows of their own; rows without an id take
    the class of an equal fingerprint, and null if no row with an id has one.  Other
    columns are ignored.  An empty table gives an empty result.
    """
    base = prints.select(F.col(ident).cast("long").alias("id"), F.coalesce("print", F.array().cast("array<int>")).alias("print"), F.coalesce(queries, F.lit(False)).alias("queried"))
    base = base.withColumn("digest", F.sha2(F.array_join("print", ","), 256))
    classes = base.where((F.size("print") > 0) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("class"), F.max("queried").alias("asked"), F.first("print").alias("print"))
    classes = stored(classes, "classes")
    asked = classes.where("asked").select("class", "print")
    blocks = -(-(asked.agg(F.sum(F.size("print"))).first()[0] or 0) // BLOCK)
    found = [classes.sparkSession.createDataFrame([], MATCHES)]
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == k).collect()
        if rows:
            found.append(_block_matches(classes, [r["class"] for r in rows], [np.array(r["print"], np.int32) for r in rows], votes, errors))
    matches = reduce(DataFrame.unionByName, found)
    matched = matches.groupBy(F.col("a").alias("class")).agg(F.count("*").alias("n_matches"), F.min_by(F.struct("b", "offset", "bit_errors"), F.struct("bit_errors", "b")).alias("m"))
    named = classes.select("digest", "class").join(matched, "class", "left")
    out = base.join(named, "digest", "left").withColumn("class", F.coalesce("class", "id"))
    return out.select(F.col("id").alias(ident), F.col("class").alias("class_id"), F.size("print").cast("long").alias("n_prints"), "queried", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("m.b").alias("best_match"), F.col("m.offset").alias("offset"), F.col("m.bit_errors").alias("bit_errors"))
