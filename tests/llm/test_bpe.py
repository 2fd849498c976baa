"""BPE by forced boundaries against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rulewright.llm import bpe
from rulewright.llm.common import groups_of_rows, text_bytes
from rulewright.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return bpe.Fragmenter(tokenizer_file()), Tokenizer.from_file(tokenizer_file())


def ids_of(fragmenter, texts):
    out, (data, offsets) = [], text_bytes(pa.array(texts, pa.string()))
    for i, j in groups_of_rows(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1 and len(part) > bpe.PART:
            out.append(np.concatenate(list(fragmenter.long_text(part))).tolist())
            continue
        ids, before = fragmenter.block(part, own[:-1])
        out += [ids[a:b].tolist() for a, b in zip(before, before[1:])]
    return out


SIGNS = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "!", "...", "é", "ж", "中文", " ", " ", "😀", "<|endoftext|>", "<|endo", "ab'd", "I'VE", "\r\n", "٣", "½", "́", "ſ", "\x00"]


def test_parts_of_random_texts(pair):
    fragmenter, whole = pair
    rng = random.Random(4)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + ["", None, "<|endoftext|><|endoftext|>", "x " * 3]
    assert ids_of(fragmenter, texts) == [e.ids for e in whole.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("text", ["中文字符" * 500_000, "QUJDREVGRw==" * 450_000, "plain words here " * 320_000, "ab " * 1_100_000], ids=["cjk", "base64", "words", "wide blanks"])
def test_texts_of_megabytes(pair, text):
    fragmenter, whole = pair
    assert ids_of(fragmenter, ["one", text, "two"]) == [whole.encode(x, add_special_tokens=False).ids for x in ("one", text, "two")]


def test_cuts_lie_inside_no_token(pair):
    """Cuts also fall inside words, where the vocabulary has no such pair."""
    fragmenter, whole = pair
    text = "zqjxkvq Wörterbuchqxz 中文a日本x".encode()
    data = np.frombuffer(text, np.uint8)
    cuts = set(bpe.forced_cuts(data, fragmenter.free).tolist())
    at, edges = 0, {0}
    tokens = bpe.token_bytes(tokenizer_file())
    for i in whole.encode(text.decode(), add_special_tokens=False).ids:
        at += len(tokens[i])
        edges.add(at)
    assert cuts and cuts <= edges
    assert any(not data[k - 1 : k + 1].tobytes().isspace() and 32 not in data[k - 1 : k + 1] for k in cuts)


def test_forgetting_changes_nothing(pair, monkeypatch):
    fragmenter, whole = pair
    monkeypatch.setattr(bpe, "REMEMBERED", 1000)
    for k in range(5):
        texts = [f"word{k}a{j} number{j * k}" for j in range(200)]
        assert ids_of(fragmenter, texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_decoding_of_broken_ids(spark):
    df = spark.createDataFrame([(1, [0, None, 999_999, -5, 1]), (2, None), (3, []), (4, [447, 1])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode_documents(df, tokenizer_file()).collect()}
    table = bpe.token_bytes(tokenizer_file())
    assert got == {1: (table[0] + table[1]).decode(), 2: "", 3: "", 4: (table[447] + table[1]).decode("utf-8", "replace")}
