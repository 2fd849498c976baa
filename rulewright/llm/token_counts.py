"""Token counts through a cache of digests.

A text's count depends only on its normalised content and on the tokenizer, so the
cache keeps one row for each pair of their digests.  A run joins the digests of its
documents with the rows stored before, encodes each distinct text that is missing
once, appends the new counts and reads the answer for every document from the cache.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BLOCK, PART, Fragmenter
from .common import dropped, groups_of_rows, hot_keys, join_with_hot, stored, text_bytes

CACHE = "content binary, n_tokens long"
#: Digests that a task remembers to send a text on once, before it forgets all of them.
REMEMBERED = 200_000


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer file and of the library that reads it: another version has counts of its own."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + hashlib.sha256(f.read()).digest()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """What of a text decides about its tokens: the text after the tokenizer's own normaliser; null as the empty text.

    A file without a normaliser (as byte-level ones) tells every two texts apart, and
    so does a ``.model`` file, whose normaliser is not asked.
    """
    text = F.coalesce(text, F.lit(""))
    if path.endswith(".model"):
        return text
    from tokenizers import Tokenizer

    if Tokenizer.from_file(path).normalizer is None:
        return text

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rule = Tokenizer.from_file(path).normalizer
        for column in columns:
            yield pa.array([rule.normalize_str(t) for t in column.to_pylist()], pa.string())

    return run(text)


def _whole_texts(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts by the library itself."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


def _kept(path: str) -> Fragmenter | Callable[[list[str]], list[int]]:
    """The tokenizer of a Python worker, read once and kept from task to task: reading it anew for each would fill the memory with holes."""
    state = sys.modules.setdefault("_rulewright_worker", types.ModuleType("_rulewright_worker"))
    if getattr(state, "path", None) != path:
        state.path = state.counter = None
        try:
            state.counter = _whole_texts(path) if path.endswith(".model") else Fragmenter(path)
        except ValueError:  # no plain byte-level file
            state.counter = _whole_texts(path)
        state.path = path
    return state.counter


def token_counts(text: Column, path: str) -> Column:
    """Number of tokens of a whole text as the file's library gives it, without special tokens added; null as the empty text."""

    @F.arrow_udf("long")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _kept(path)
        for column in columns:
            if not hasattr(counter, "block"):
                texts = column.fill_null("")
                _, offsets = text_bytes(texts)
                found = [counter(texts.slice(i, j - i).to_pylist()) for i, j in groups_of_rows(offsets, BLOCK)]
                yield pa.array([n for group in found for n in group], pa.int64())
                continue
            data, offsets = text_bytes(column)
            counts = [np.empty(0, np.int64)]
            for i, j in groups_of_rows(offsets, BLOCK):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if j == i + 1 and len(part) > PART:
                    counts.append(np.array([sum(map(len, counter.long_text(part)))], np.int64))
                else:
                    counts.append(np.diff(counter.block(part, own[:-1])[1]))
            yield pa.array(np.concatenate(counts), pa.int64())

    return run(text)


def first_here(digest: Column) -> Column:
    """Whether a digest is new to the task: copies go no further, but for some after it forgot."""
    most = REMEMBERED

    @F.arrow_udf("boolean")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: set[bytes] = set()
        for column in columns:
            fresh = []
            for d in column.to_pylist():
                fresh.append(d not in seen)
                seen.add(d)
            if len(seen) > most:
                seen = set()
            yield pa.array(fresh, pa.bool_())

    return run.asNondeterministic()(digest)


def _cached(spark: SparkSession, folder: str) -> DataFrame:
    """Counts stored so far, one row a digest; runs that overlapped may have stored some twice, alike."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(documents: DataFrame, path: str, cache: str, text: str = "text", counted: str = "n_tokens") -> DataFrame:
    """``documents`` without their text, with ``n_bytes`` (UTF-8) and the token count of every whole text.

    ``cache`` is a folder on shared storage that grows from run to run; it holds a
    folder for each tokenizer version.  Only texts whose digest has no row there are
    moved and encoded, each distinct one once.  Copies are thinned out where they lie
    before anything is shuffled, and rows of a hot digest meet a broadcast of its
    count.  Nulls count as empty texts, which have no bytes and no tokens; other
    columns are kept (``n_bytes`` and ``counted`` are replaced); an empty table gives an
    empty result.  A run that fails half-way leaves true rows only.
    """
    spark, folder = documents.sparkSession, f"{cache.rstrip('/')}/tokenizer={tokenizer_version(path)}"
    digest = F.unhex(F.sha2(normalised(F.col(text), path), 256))
    others = [c for c in documents.columns if c not in (text, "n_bytes", counted)]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = stored(documents.select(*others, size.alias("n_bytes"), digest.alias("_content")), "digests")
    wanted = rows.select(F.col("_content").alias("content")).distinct()
    missing = stored(wanted.join(_cached(spark, folder).select("content"), "content", "left_anti"), "missing")
    texts = documents.select(digest.alias("content"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = texts.where(first_here(F.col("content"))).join(missing, "content", "left_semi")
    once = texts.groupBy("content").agg(F.first("_text").alias("_text"))
    once.select("content", token_counts(F.col("_text"), path).alias("n_tokens")).write.mode("append").parquet(folder)
    counts = _cached(spark, folder).withColumnRenamed("content", "_content")
    hot = stored(hot_keys(rows, ["_content"], rows.count()), "hot")
    out = join_with_hot(rows, counts, ["_content"], hot).select(*others, "n_bytes", F.col("n_tokens").alias(counted))
    out = stored(out, "token-counts")
    dropped(rows, missing, hot)
    return out
