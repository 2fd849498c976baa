"""Registered queries of the training-data operators, with SQL twins where SQL can state them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_documents, encode_documents
from .chroma import align_recordings, tone_prints
from .common import shared_dir, stored
from .ctw import score_documents
from .html_blocks import extract_main_text
from .kd_shards import shard_documents
from .mixing import mix_sources
from .ngram_join import jaccard_classes
from .quality_rules import quality_verdicts
from .spelling import variant_groups
from .token_counts import count_tokens
from .url_lists import judge_captures, validity_intervals
from .warc import read_archives, resolve_revisits, with_originals, write_archives
from .whitening import whiten

QUERIES: dict = {}
ORACLES: dict = {}


def registered(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered("op1_ngram_jaccard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 4-word shingle sets of Jaccard similarity 0.85 or more."""
    return jaccard_classes(table(spark, sf_dir, "documents"), size=4, p=85, q=100)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files lie; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@registered("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them."""
    path = tokenizer_file()
    ids = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    both = decode_documents(ids, path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@registered("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@registered("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the learned rules keep it."""
    judged = quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@registered("op7_kd_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 of nearly equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@registered("op9_warc_revisits", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archives, written with revisits and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    write_archives(resolve_revisits(pages, "page_id", "html"), path, "page_id", "url", "html")
    back = with_originals(stored(read_archives(spark, path).drop("payload"), "headers"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return back.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


#: Captures are fetched 37 minutes apart by page id, over 400 days; entries follow from the hosts and paths of the pages.
OP10_ENTRIES = """
WITH p AS (SELECT page_id, lower(url) AS url FROM pages WHERE url IS NOT NULL),
h AS (SELECT page_id, regexp_extract(url, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1) AS host,
             regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) AS part FROM p),
k AS (SELECT host AS key, min(page_id) AS m FROM h WHERE host <> '' GROUP BY host
      UNION ALL SELECT regexp_replace(host, '^[^.]*[.]', '') AS key, min(page_id) AS m FROM h WHERE host LIKE '%.%.%' GROUP BY 1
      UNION ALL SELECT concat(host, part) AS key, min(page_id) AS m FROM h WHERE host <> '' AND part <> '' GROUP BY 1),
e AS (SELECT key, min(m) AS m FROM k GROUP BY key),
n AS (SELECT key, m, 0 AS i, CASE WHEN m % 2 = 0 THEN 'block' ELSE 'allow' END AS action, m % 50 AS day FROM e
      UNION ALL SELECT key, m, 1 AS i, 'off' AS action, m % 50 + 20 + m % 31 AS day FROM e
      UNION ALL SELECT key, m, 2 AS i, CASE WHEN m % 3 = 0 THEN 'allow' ELSE 'block' END AS action, m % 50 + 90 + m % 97 AS day FROM e
      UNION ALL SELECT key, m, 3 AS i, 'off' AS action, m % 50 + 250 + m % 61 AS day FROM e WHERE m % 4 <> 1)
"""
OP10_SQL = (
    "WITH "
    + OP10_ENTRIES.strip().removeprefix("WITH ")
    + r""",
v AS (SELECT key, action, day AS f, lead(day) OVER (PARTITION BY key ORDER BY day) AS t FROM n),
c AS (SELECT page_id, url, (page_id * 37) % 576000 AS minute, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1) AS host,
             regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) AS part FROM pages),
s AS (SELECT page_id, minute, array_to_string(string_split(host, '.')[i:], '.') AS key FROM (SELECT *, unnest(range(1, greatest(1, len(string_split(host, '.')) - 1) + 1)) AS i FROM c WHERE host <> '')
      UNION ALL SELECT page_id, minute, host || part FROM c WHERE host <> '' AND part <> ''),
b AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY length(v.key) DESC, v.key DESC) AS o, v.key, v.action, v.f, v.t
      FROM s JOIN v ON s.key = v.key AND v.action <> 'off' AND minute >= v.f * 1440 AND (v.t IS NULL OR minute < v.t * 1440))
SELECT c.page_id, c.url, (TIMESTAMP '2024-01-01' + to_minutes(minute))::VARCHAR AS fetched_at, coalesce(b.action, 'unlisted') AS verdict, b.key AS list_key,
       f::BIGINT AS valid_from_day, t::BIGINT AS valid_to_day
FROM c LEFT JOIN b ON c.page_id = b.page_id AND o = 1
"""
)


@registered("op10_url_lists", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture judged by the list entries valid at its fetch."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = OP10_ENTRIES.replace("FROM pages", "FROM {pages}")
    entries = spark.sql(listed + "SELECT key, action, timestamp'2024-01-01 00:00:00' + make_dt_interval(day) AS listed_at FROM n", pages=pages)
    fetched = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, (page_id * 37) % 576000)")
    judged = judge_captures(pages.withColumn("fetched_at", fetched), validity_intervals(entries))
    day = lambda c: F.date_diff(F.col(c), F.lit("2024-01-01")).cast("long")
    return judged.select("page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "verdict", "list_key", day("valid_from").alias("valid_from_day"), day("valid_to").alias("valid_to_day"))


@registered("op5_ctw")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-unigram and context-tree scores of every document."""
    return score_documents(table(spark, sf_dir, "documents"))


@registered("op4_chroma")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of the embeddings played as tones; those whose id 20 divides aligned with all."""
    audio = table(spark, sf_dir, "embeddings").select("vec_id", tone_prints(F.col("embedding")).alias("print"))
    return align_recordings(stored(audio, "prints"), F.col("vec_id") % 20 == 0, "vec_id")


@registered("op6_html_blocks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@registered("op11_spelling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their near words, usual form and root."""
    return variant_groups(table(spark, sf_dir, "documents"))


@registered("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by a cache that begins empty, so that a run never rests on an earlier one."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(documents, tokenizer_file(), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@registered("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
