"""BPE encoding and decoding by forced boundaries.

A byte pair that stands side by side in no vocabulary token can never be merged
across, so a cut there changes no merge.  A text is first parted where the
tokenizer's own rule parts it (runs of letters, digits, other signs and white
space), then at every such pair inside those parts.  The fragments between cuts are
encoded independently, each distinct one of a block once, and their ids are
concatenated.  All parting is done on whole blocks of text with numpy; only distinct
fragments are handled one by one.  The tokenizer file is a parameter and must be
readable on every executor.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _powers, groups_of_rows, mix, text_bytes

#: Bytes of fragments and ids that a task remembers before it forgets all of them, and the longest fragment remembered.
REMEMBERED, LONGEST = 40 << 20, 64
#: Bytes of texts that are parted together; each takes some 120 bytes of memory meanwhile.
BLOCK = 1 << 19
#: A longer text is taken in parts of about this many bytes, where a part can begin on its own.
PART = 1 << 20
_LETTER, _DIGIT, _OTHER, _SPACE, _UNKNOWN = range(5)
#: What follows an apostrophe that begins a part of its own (fixed values of the byte-level rule).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer file."""
    from tokenizers import Tokenizer

    return _token_bytes(Tokenizer.from_file(path).get_vocab(with_added_tokens=True))


def _token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    byte = {c: b for b, c in enumerate(byte_symbols())}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token)
    return out


def never_adjacent(tokens: list[bytes]) -> np.ndarray:
    """A 256 x 256 table, true for the byte pairs that occur inside no token."""
    free = np.ones((256, 256), bool)
    for token in tokens:
        for pair in zip(token, token[1:]):
            free[pair] = False
    return free


def forced_cuts(data: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Places in ``data`` that a token can never span: between bytes that no token has side by side."""
    return np.flatnonzero(free[data[:-1], data[1:]]) + 1


class Fragmenter:
    """Parts texts into fragments and encodes them as the whole tokenizer would."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule = spec.get("pre_tokenizer") or {}
        if rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("the tokenizer is no plain byte-level one")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take their surroundings in are not known")
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        del spec
        self.merges = Tokenizer.from_file(path)
        self.rule = self.merges.pre_tokenizer
        self.free = never_adjacent(_token_bytes(self.merges.get_vocab(with_added_tokens=True)))
        # Only the merges are left to it: fragments come as byte symbols.
        self.merges.pre_tokenizer = None
        self.merges.no_truncation()
        self.merges.no_padding()
        self.encode = getattr(self.merges, "encode_batch_fast", self.merges.encode_batch)
        self.symbols = np.array([ord(c) for c in byte_symbols()], np.uint16)
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self.known: dict[bytes, bytes] = {}  # fragment to its ids, four bytes each
        self.held = 0

    def _kinds_of(self, points: np.ndarray) -> np.ndarray:
        """Letter, digit, other or space, as the tokenizer's rule sees each character; new characters are tried out on it."""
        found = self.kinds[points]
        if (found == _UNKNOWN).any():
            for c in np.unique(points[found == _UNKNOWN]).tolist():
                whole = [len(self.rule.pre_tokenize_str(x + chr(c))) == 1 for x in "a1!"]
                self.kinds[c] = whole.index(True) if any(whole) else _SPACE
            found = self.kinds[points]
        return found

    def parts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Byte positions where a part begins, by the rule; ``starts`` begin texts of their own."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where each character begins
        kind = self._kinds_of(points)
        n = len(points)
        begins = np.zeros(n + 1, bool)
        begins[np.searchsorted(at, starts)] = True
        begins[n] = True
        fresh = begins[:n].copy()
        cut = fresh.copy()
        cut[1:] |= kind[1:] != kind[:-1]
        # The last white space before something else stands alone, or goes with it if it is a blank.
        space = kind == _SPACE
        ends = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:])
        cut[ends] = True
        cut[ends[points[ends] == 32] + 1] = False
        # An apostrophe that begins a part, and what follows it, may be a part of their own.
        quotes = np.flatnonzero((points == 39) & cut)
        if len(quotes):
            ahead = np.concatenate([points, np.zeros(3, np.uint32)])
            left = np.flatnonzero(begins)
            left = left[np.searchsorted(left, quotes, "right")] - quotes  # characters to the end of the text
            size = np.zeros(len(quotes), np.int64)
            for word in reversed(CONTRACTIONS):
                fits = left > len(word)
                for k, c in enumerate(word):
                    fits &= ahead[quotes + 1 + k] == ord(c)
                size[fits] = len(word)
            quotes, size = quotes[size > 0], size[size > 0]
            cut[quotes + 1] = False
            after = quotes + size + 1
            cut[after[after < n]] = True
            # A blank goes with the run behind a contraction only if the run begins there; that is so already.
        return at[cut]

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each fragment, four bytes each."""
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            new = list(set(new))
            text = self.symbols[np.frombuffer(b"".join(new), np.uint8)].astype("<u2").tobytes().decode("utf-16-le")
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in new])]).tolist()
            got = self.encode([text[a:b] for a, b in zip(bounds, bounds[1:])], add_special_tokens=False)
            fresh = {p: array("i", g.ids).tobytes() for p, g in zip(new, got)}
            out = [known[p] if p in known else fresh[p] for p in pieces]
            if self.held > REMEMBERED:
                known.clear()
                self.held = 0
            for p, ids in fresh.items():
                if len(p) <= LONGEST:
                    known[p] = ids
                    self.held += len(p) + len(ids) + 200
            return out
        return [known[p] for p in pieces]

    def block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and how many ids stand before each of ``starts`` and the end."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(starts) + 1, np.int64)
        raw = data.tobytes()
        special: dict[int, int] = {}
        for content, i in self.added.items():
            k = raw.find(content)
            while k >= 0:
                # A match across the end of a text is none.
                j = np.searchsorted(starts, k, "right")
                if (j == len(starts) or k + len(content) <= starts[j]) and k not in special:
                    special[k] = i
                k = raw.find(content, k + 1)
        own = np.asarray(starts[starts < len(data)], np.int64)
        if special:
            taken, keep = -1, {}
            for k in sorted(special):
                if k >= taken:
                    keep[k] = special[k]
                    taken = k + len(next(c for c, i in self.added.items() if i == special[k]))
            special = keep
            edges = [x for k, i in special.items() for x in (k, k + len(next(c for c, j in self.added.items() if j == i)))]
            own = np.sort(np.concatenate([own, np.array([x for x in edges if x < len(data)], np.int64)]))
        cut = np.zeros(len(data), bool)
        cut[0] = True
        for places in (own, self.parts(data, own), forced_cuts(data, self.free)):
            cut[places] = True
        for k, i in special.items():
            cut[k + 1 : k + len(next(c for c, j in self.added.items() if j == i))] = False
        at = np.flatnonzero(cut)
        size = np.diff(np.append(at, len(data)))
        up, down = _powers(len(data) + 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_CODES[data] * up[: len(data)], out=total[1:])
        _, first, same = np.unique(mix((total[at + size] - total[at]) * down[at] + size.astype(np.uint64)), return_index=True, return_inverse=True)
        # Fragments of one hash are compared byte by byte with the first of them.
        there = np.repeat(at[first][same] - at, size) + np.arange(len(data))
        if (size[first][same] != size).any() or (data[there.clip(0, len(data) - 1)] != data).any():
            first, same = np.arange(len(at)), np.arange(len(at))
        pieces = [raw[a : a + n] for a, n in zip(at[first].tolist(), size[first].tolist())]
        ids = self._ids(pieces)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.int32)
        begin = (np.cumsum(lengths) - lengths)[same]
        count = lengths[same]
        if special:
            for k, i in special.items():
                j = int(np.searchsorted(at, k))
                count[j], begin[j] = 1, len(flat)
                flat = np.append(flat, np.int32(i))
        ends = np.concatenate([[0], np.cumsum(count)])
        out = flat[np.repeat(begin - ends[:-1], count) + np.arange(ends[-1])]
        return out, np.append(ends[np.searchsorted(at, np.minimum(starts, len(data)))], ends[-1])

    def long_text(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of a long text, part by part; a part begins at a blank between two letters, which any reading parts alike."""
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        at = 0
        while len(data) - at > PART:
            step = PART // 2
            while True:
                window = data[at + step : at + step + PART]
                safe = np.flatnonzero(ascii_letter[window[:-2]] & (window[1:-1] == 32) & ascii_letter[window[2:]])
                if len(safe) or at + step + PART >= len(data):
                    break
                step += PART - 2
            if not len(safe):
                break
            end = at + step + int(safe[0]) + 1
            yield self.block(data[at:end], np.zeros(1, np.int64))[0]
            at = end
        yield self.block(data[at:], np.zeros(1, np.int64))[0]


def encoded(text: Column, path: str) -> Column:
    """Token ids of a text as the file's own tokenizer gives them, without special tokens added.

    Null is encoded as the empty text, which has no ids.  A special token's own
    text inside a text is that token, as in the library.  Texts may be of any
    length; equal texts get equal ids.
    """

    @F.arrow_udf("array<int>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        fragmenter = Fragmenter(path)
        for column in columns:
            data, offsets = text_bytes(column)
            flat, lengths = [], []
            for i, j in groups_of_rows(offsets, BLOCK):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if j == i + 1 and len(part) > PART:
                    found = list(fragmenter.long_text(part))
                    flat += found
                    lengths.append(np.array([sum(map(len, found))]))
                else:
                    ids, before = fragmenter.block(part, own[:-1])
                    flat.append(ids)
                    lengths.append(np.diff(before))
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))] if lengths else [[0]]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), pa.int32()))

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of token ids, special tokens included; null is decoded as no ids.

    Bytes that are no valid UTF-8 become the replacement character; unknown and
    null ids are left out.  The bytes of a whole batch are gathered from one flat
    table of the vocabulary.
    """

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = token_bytes(path)
        table = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array([*map(len, tokens), 0], np.int64)  # the last one stands for ids without a token
        first = np.cumsum(size) - size
        for column in columns:
            rows = np.array(column.value_lengths().fill_null(0), np.int64)
            values = column.flatten()
            given = np.array(values.fill_null(-1), np.int32)
            given[(given < 0) | (given >= len(tokens))] = len(tokens)
            bounds = np.concatenate([[0], np.cumsum(rows)])
            out: list[pa.Array] = []
            i = 0
            while i < len(rows):  # a quarter of a million ids at a time, about
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + (1 << 18), "right")) - 1)
                part = given[bounds[i] : bounds[j]]
                count = size[part]
                ends = np.concatenate([[0], np.cumsum(count)])
                data = table[np.repeat(first[part] - ends[:-1], count) + np.arange(ends[-1])]
                edge = ends[bounds[i : j + 1] - bounds[i]]
                out.append(_strings(data, edge))
                i = j
            yield pa.concat_arrays(out) if out else pa.array([], pa.string())

    return run(ids)


def _strings(data: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Strings between the edges of bytes; taken as they are where all is valid UTF-8."""
    raw = data.tobytes()
    inner = edge[(edge > 0) & (edge < len(data))]
    try:
        raw.decode("utf-8")
        valid = not ((data[inner] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        valid = False
    if valid:
        return pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(raw))
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(edge.tolist(), edge[1:].tolist())], pa.string())


def encode_documents(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``documents`` with the ids of the whole text as column ``ids`` (replaced if it was there).

    Other columns are kept; an empty table gives an empty result.
    """
    return documents.withColumn(ids, encoded(F.col(text), path))


def decode_documents(documents: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``documents`` with the text of ``ids`` as column ``text`` (replaced if it was there)."""
    return documents.withColumn(text, decoded(F.col(ids), path))
