"""WARC archives: revisit resolution, writing and reading.

Headers (digest, id) are shuffled by payload digest.  Of the captures with one
payload the smallest id is the response, the others are written as revisits of it.
A Bloom filter of the digests that occur twice tells every task which captures can
have a copy; all others are responses and are written where they are.  Of the rest
only headers move, and a payload goes once from a task to the capture that is its
response.  Archives are written by Spark's text writer, whose line separator is the
blank lines that end a WARC record, so any store that Spark writes to will do and a
lost task is written again.  A file is one gzip member; files of one member per record
are read as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, hot_keys, join_with_hot, stored
from .token_counts import first_here

#: Shorter payloads are always written whole.
SHORTEST = 100
#: Bytes of payloads in an archive at most, unless a single record has more.
BYTES = 64 << 20
#: Payloads up to these bytes share files of their own, so that a number of records bounds the bytes.
SIZES = (2 << 10, 64 << 10, 1 << 20, 16 << 20)
#: Bits of the filter per digest and at most (64 MB): a fuller filter lets more headers move, nothing else.
BITS, MOST_BITS, PROBES = 10, 1 << 29, 5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "record_id string, record_type string, target string, written_at string, digest string, refers_to string, payload_bytes long, payload_digest string, payload string"


def _probes(digests: np.ndarray, bits: int) -> np.ndarray:
    """Places of each 32-byte digest in a filter, one column per probe."""
    words = digests.reshape(-1, 32)[:, :16].copy().view(np.uint64)
    return (words[:, :1] + np.arange(PROBES, dtype=np.uint64) * (words[:, 1:] | np.uint64(1))) % np.uint64(bits)


def bloom_filter(digests: DataFrame, column: str = "_d") -> np.ndarray:
    """Bits of a filter that holds every 32-byte digest: tasks set bits in words of their own, which Spark joins by OR."""
    bits = int(max(64, min(MOST_BITS, digests.count() * BITS))) // 64 * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_probes(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), bits))
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(values.view(np.int64))], ["word", "bits"])

    found = digests.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _may_hold(spark: SparkSession, bits: np.ndarray, digest: Column) -> Column:
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = shared.value.view(np.uint64)
        for column in columns:
            at = _probes(np.frombuffer(b"".join(column.to_pylist()), np.uint8), 64 * len(words))
            yield pa.array(((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1))

    return run(digest)


def resolve_revisits(captures: DataFrame, ident: str, payload: str, shortest: int = SHORTEST) -> DataFrame:
    """``captures`` with payload_digest, payload_bytes, record_type and refers_to.

    A null payload is empty.  Payloads under ``shortest`` bytes are all responses.  If
    all ids of a payload are null, its captures are responses.  Rows with the same
    smallest id are all responses.  A revisit's payload is null: it is that of the response.  Columns named
    like a result are replaced; an empty table gives an empty result.
    """
    spark = captures.sparkSession
    captures = captures.drop("payload_digest", "payload_bytes", "record_type", "refers_to")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = captures.withColumn("payload_digest", F.sha2(body, 256)).withColumn("payload_bytes", F.octet_length(body).cast("long"))
    rows = rows.withColumn("_d", F.unhex("payload_digest"))
    headers = rows.where(F.col("payload_bytes") >= shortest).select("_d", F.col(ident).alias("_first"))
    again = headers.groupBy("_d").agg(F.count("*").alias("_n"), F.min("_first").alias("_first")).where("_n > 1 and _first is not null")
    again = stored(again.select("_d", "_first"), "digests")
    maybe = F.when(F.col("payload_bytes") >= shortest, _may_hold(spark, bloom_filter(again), F.col("_d"))).otherwise(False)
    marked = rows.withColumn("_maybe", maybe)
    out = [*rows.columns, "record_type", "refers_to"]
    nothing = F.lit(None).cast(captures.schema[ident].dataType)
    alone = marked.where("not _maybe").withColumn("record_type", F.lit("response")).withColumn("refers_to", nothing).select(*out)

    moved = stored(marked.where("_maybe").drop("_maybe", payload), "headers")
    hot = stored(hot_keys(moved, ["_d"], moved.count()), "hot")
    later = F.col("_first").isNotNull() & ~F.col(ident).eqNullSafe(F.col("_first"))
    decided = join_with_hot(moved, again, ["_d"], hot, "left").withColumn("record_type", F.when(later, "revisit").otherwise("response")).withColumn("refers_to", F.when(later, F.col("_first"))).drop("_first")
    decided = stored(decided, "decided")
    revisits = decided.where("record_type = 'revisit'").withColumn(payload, F.lit(None).cast("string")).select(*out)
    # Each payload once a task, whatever its copies.
    bodies = marked.where("_maybe").select("_d", payload).where(first_here(F.col("_d"))).groupBy("_d").agg(F.first(payload).alias(payload))
    responses = decided.where("record_type = 'response'").join(bodies, "_d").select(*out)
    dropped(moved, hot)
    return alone.unionByName(revisits).unionByName(responses).drop("_d")


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archives(records: DataFrame, path: str, ident: str, target: str, payload: str, name: str = "urn:page:") -> None:
    """Write resolved captures as gzipped WARC 1.1 files with fresh headers.

    A response holds the HTTP head and the payload, a revisit the HTTP head alone.
    Payloads of one range of sizes share files, as many as cannot come to more than ``BYTES``;
    a larger payload has a file of its own.
    """
    classes = reduce(lambda c, k: F.when(F.col("payload_bytes") <= SIZES[k], k).otherwise(c), reversed(range(len(SIZES))), F.lit(len(SIZES)))
    present = sorted(r.c for r in records.select(classes.alias("c")).distinct().collect())
    body = F.coalesce(F.col(payload), F.lit(""))
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(end * 2))
    block = F.when(F.col("record_type") == "response", F.concat(http, body)).otherwise(http)
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "),
        F.col("record_type"),
        F.lit(f"{end}WARC-Record-ID: <{name}"),
        F.coalesce(F.col(ident).cast("string"), F.lit("")),
        F.lit(f">{end}WARC-Date: "),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit(f"{end}WARC-Target-URI: "), _one_line(F.col(target))), F.lit("")),
        F.lit(f"{end}WARC-Payload-Digest: sha256:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: {PROFILE}{end}WARC-Refers-To: <{name}"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(end * 2),
    )
    for k in present or [0]:
        most = max(1, BYTES // (SIZES[k] + 600)) if k < len(SIZES) else 1
        own = records.where(classes == k).select(F.concat(head, block).alias("value"))
        own.write.mode("append").option("lineSep", end * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _records(stream: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Header fields, their names in lower case, and block of each record of an archive's bytes."""
    held, more = bytearray(), True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            part = next(stream, None)
            more = part is not None
            held.extend(part or b"")
        return len(held) >= n

    while fill(1):
        while (at := held.find(b"\r\n\r\n")) < 0 and fill(len(held) + 1):
            pass
        if at < 0:
            raise ValueError("an archive ends inside a header")
        lines = held[:at].decode("utf-8", "replace").split("\r\n")
        pairs = (x.partition(":") for x in lines[1:])
        fields = {k.strip().lower(): v.strip() for k, _, v in pairs}
        n = int(fields["content-length"])
        if not lines[0].startswith("WARC/") or not fill(at + 8 + n) or held[at + 4 + n : at + 8 + n] != b"\r\n\r\n":
            raise ValueError("an archive holds a broken record")
        yield fields, bytes(held[at + 4 : at + 4 + n])
        del held[: at + 8 + n]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, in the columns of ``READ``.

    payload_bytes and payload_digest are those of the payload that the record
    holds, and null for a revisit, which holds none.  Files are unpacked as streams,
    member by member; a broken record is an error.  Bytes of a payload that are no
    UTF-8 become the replacement character in ``payload``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import zlib

        def unpacked(raw: bytes) -> Iterator[bytes]:
            z, rest = zlib.decompressobj(31), memoryview(raw)
            for at in range(0, len(rest), 1 << 16):
                part = rest[at : at + (1 << 16)]
                while len(part):
                    yield z.decompress(part)
                    part = z.unused_data
                    if z.eof:  # what follows is the next member
                        z = zlib.decompressobj(31)
            yield z.flush()

        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.string() for x in READ.split(", ")]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for fields, block in _records(unpacked(batch.column(0)[k].as_py())):
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if fields["warc-type"] == "response" else None
                    own = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), payload.decode("utf-8", "replace"))
                    rows.append((fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields["warc-date"], fields.get("warc-payload-digest", "").removeprefix("sha256:"), fields.get("warc-refers-to"), *own))
                    held += len(block)
                    if held > 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def with_originals(records: DataFrame) -> DataFrame:
    """Records read back, revisits completed with length and digest of the response that has their payload digest."""
    whole = records.where("record_type = 'response'").select(F.col("record_id").alias("original"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("h")).dropDuplicates(["original", "h"])
    own = records.where("record_type = 'response'")
    again = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    again = again.join(whole, (again["refers_to"] == whole["original"]) & (again["digest"] == whole["h"]), "left").withColumnsRenamed({"n": "payload_bytes", "h": "payload_digest"}).drop("original")
    return own.unionByName(again)
