"""Reading archives of other makers, and the two ways of resolving revisits."""

import gzip
import hashlib
import uuid

from rulewright.llm import warc
from rulewright.llm.common import shared_dir


def record(k, payload, name="Content-Length"):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type:response\r\nwarc-record-id: <urn:page:{k}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nX-Odd:  a: b \r\n{name}: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def written(spark, tmp_path, raw):
    path = tmp_path / f"{uuid.uuid4().hex}.warc.gz"
    path.write_bytes(raw)
    return {r.record_id: r for r in warc.read_archives(spark, str(path)).collect()}


def test_one_member_per_record(spark, tmp_path):
    payloads = [b"<p>one</p>", b"\xff\xfe no utf-8", b"", b"x" * 300_000, "äöü".encode()]
    members = b"".join(gzip.compress(record(k, p, "content-length" if k % 2 else "Content-Length")) for k, p in enumerate(payloads))
    whole = gzip.compress(b"".join(record(k, p) for k, p in enumerate(payloads)))
    for raw in (members, whole):
        got = written(spark, tmp_path, raw)
        assert len(got) == len(payloads)
        for k, p in enumerate(payloads):
            r = got[f"<urn:page:{k}>"]
            assert (r.payload_bytes, r.payload_digest, r.payload) == (len(p), hashlib.sha256(p).hexdigest(), p.decode("utf-8", "replace"))


def resolved(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(5)
    return warc.resolve_revisits(df, "page_id", "html").collect()


def test_any_filter_gives_the_same(spark, monkeypatch):
    """Half of the rows have one payload; a filter that is far too small lets everything through and changes nothing."""
    long = "y" * 150
    rows = [(k, f"u{k}", long + str(k % 5), k) for k in range(40)] + [(None, "n", long + "0", 1), (50, "v", None, 1), (51, "w", "z" * 2_000_000, 1), (52, "w", "z" * 2_000_000, 1), (7, "again", "short", 1), (8, "again", "short", 1)]
    rows += [(100 + k, "hot", "h" * 300, 1) for k in range(120)] + [(200 + k, "alone", f"{k}" * 200, 1) for k in range(60)]
    rows += [(5, "u5", long + "0", 5), (None, "q", "nobody" * 40, 1), (None, "q", "nobody" * 40, 1), (100, "hot", "h" * 300, 1)]
    few = sorted(resolved(spark, rows), key=str)
    monkeypatch.setattr(warc, "MOST_BITS", 64)
    assert few == sorted(resolved(spark, rows), key=str) and len(few) == len(rows)
    monkeypatch.undo()
    smallest = {}
    for i, _, h, _ in rows:
        if i is not None:
            smallest[h or ""] = min(i, smallest.get(h or "", i))
    for r in few:
        html = next(h for i, u, h, _ in rows if (i, u) == (r.page_id, r.url)) or ""
        first = smallest.get(html)
        revisit = len(html) >= 100 and first is not None and r.page_id != first
        assert (r.record_type, r.refers_to, r.payload_bytes) == ("revisit" if revisit else "response", first if revisit else None, len(html))
        assert r.payload_digest == hashlib.sha256(html.encode()).hexdigest() and (r.html or "") == ("" if revisit else html)


def test_no_captures(spark):
    assert resolved(spark, []) == []


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    """Small pages share files; a run of large ones is cut by their own size, not by the mean."""
    monkeypatch.setattr(warc, "BYTES", 200_000)
    rows = [(k, "u", str(k) * 50) for k in range(300)] + [(1000 + k, "u", str(k % 10) * (90_000 + k)) for k in range(12)] + [(2000, "u", "x" * 3_000_000)]
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.resolve_revisits(df, "page_id", "html"), path, "page_id", "url", "html")
    files = [r.content for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    sizes = sorted(len(gzip.decompress(bytes(f))) for f in files)
    assert sizes[-1] > 3_000_000 and sizes[-2] < 200_000 and len(files) < 40
    assert warc.read_archives(spark, path).count() == len(rows)
