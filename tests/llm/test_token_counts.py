"""Token counts against the libraries, and what a cache saves."""

import uuid

import pytest

from rulewright.llm import token_counts as T
from rulewright.llm.common import shared_dir
from rulewright.llm.queries import QUERIES, table, tokenizer_file

TEXTS = ["", None, "word", "word", "Héllo  wörld's\n\n\tx", "<|endoftext|> in a text<|endoftext|>", "  ", "漢字 かな " * 50, "a" * 5000, "it's we'll    end ", "word "]


def by_library(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        one = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(one.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(path)
    one.no_truncation()
    one.no_padding()
    return [len(one.encode(t or "", add_special_tokens=False).ids) for t in texts]


def folder(spark):
    return f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"


def test_query(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    want = {(r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(rows, by_library(tokenizer_file(), [r.text for r in rows]))}
    found = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_counts"](spark, sf).collect()]
    assert len(found) == len(rows) and set(found) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_texts(spark, name):
    path = tokenizer_file(name)
    texts = [*TEXTS, "some words and digits 123 \n" * 60_000]
    df = spark.createDataFrame([(k, t, 5, b"x") for k, t in enumerate(texts)] + [(None, "word", 5, b"y"), (3, "word", 5, b"x")], "doc_id long, text string, n_tokens int, content binary")
    out = T.count_tokens(df, path, folder(spark))
    assert out.columns == ["doc_id", "content", "n_bytes", "n_tokens"]
    found = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()), key=str)
    want = [(k, len((t or "").encode()), n) for (k, t), n in zip(enumerate(texts), by_library(path, texts))]
    extra = by_library(path, ["word"])[0]
    assert found == sorted([*want, (None, 4, extra), (3, 4, extra)], key=str)


def test_cache_is_read_and_appended_to(spark):
    path, cache = tokenizer_file(), folder(spark)
    df = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    T.count_tokens(df(["one", "two", "two", None, ""] + ["hot"] * 500), path, cache).collect()
    rows = lambda: spark.read.parquet(f"{cache}/tokenizer={T.tokenizer_version(path)}")
    assert rows().count() == 4 == rows().select("content").distinct().count()
    # What is stored is believed: a changed count comes back for a known text only.
    rows().selectExpr("content", "n_tokens + 100 as n_tokens").write.parquet(f"{cache}/other")
    spark.read.parquet(f"{cache}/other").write.mode("append").parquet(f"{cache}/tokenizer={T.tokenizer_version(path)}")
    found = {r.text: r.n_tokens for r in df(["one", "three"]).join(T.count_tokens(df(["one", "three"]), path, cache), "doc_id").collect()}
    assert found == {"one": 101, "three": 1} and rows().count() == 9
    # Another tokenizer has counts of its own.
    other = tokenizer_file("word_bpe_49k.json")
    assert T.tokenizer_version(other) != T.tokenizer_version(path)
    assert [r.n_tokens for r in T.count_tokens(df(["one"]), other, cache).collect()] == [1]


def test_forgetful_tasks_still_encode_once(spark, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 2)
    path, cache = tokenizer_file(), folder(spark)
    df = spark.createDataFrame([(k, f"text {k % 7}") for k in range(400)], "doc_id long, text string")
    assert {r.n_tokens for r in T.count_tokens(df, path, cache).collect()} == {2}
    assert spark.read.parquet(f"{cache}/tokenizer={T.tokenizer_version(path)}").count() == 7


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, more int")
    out = T.count_tokens(none, tokenizer_file(), folder(spark))
    assert out.columns == ["doc_id", "more", "n_bytes", "n_tokens"] and out.collect() == []
