import datetime as dt
import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.llm import chroma
from rulewright.llm import html_blocks as hb
from rulewright.llm.common import shared_dir
from rulewright.llm.url_lists import judge_captures, list_keys, validity_intervals
from rulewright.llm.warc import read_archives, resolve_revisits, with_originals, write_archives


def test_warc_round_trip(spark):
    long = "<p>" + "ä" * 80 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX: y", long), (9, None, long), (1, "http://c/", "short"), (2, "http://c/", "short"), (4, "http://d/", None), (6, "http://e/", ""), (3, "http://b2/", long)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve_revisits(df, "page_id", "html"), path, "page_id", "url", "html")
    back = with_originals(read_archives(spark, path)).collect()
    assert len(back) == len(rows)
    got = sorted((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.payload) for r in back if r.record_id not in ("<urn:page:3>",))
    raw = long.encode()
    digest = hashlib.sha256(raw).hexdigest()
    for ident, kind, n, h, refers, payload in got:
        if ident in ("<urn:page:5>", "<urn:page:9>"):
            assert (kind, n, h, refers, payload) == ("revisit", len(raw), digest, "<urn:page:3>", None)
        else:
            want = {"<urn:page:1>": "short", "<urn:page:2>": "short"}.get(ident, "")
            assert (kind, n, payload, refers) == ("response", len(want), want, None)
    assert [r.payload for r in back if r.record_id == "<urn:page:3>"] == [long, long]


def test_warc_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve_revisits(df, "page_id", "html"), path, "page_id", "url", "html")
    assert with_originals(read_archives(spark, path)).collect() == []


def test_list_keys(spark):
    keys = lambda u: spark.range(1).select(list_keys(F.lit(u).cast("string")).alias("k")).first().k
    assert keys("HTTP://u:p@A.b.Example.com:80/X/y?z") == ["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x"]
    assert keys("https://localhost") == ["localhost"]
    assert keys("no url") == [] and keys("") == []


def test_captures_see_the_entries_of_their_time(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    entries = spark.createDataFrame([("x.com", "block", t(3)), ("x.com", "off", t(5)), ("x.com", "allow", t(9)), ("a.x.com", "allow", t(4)), ("x.com/bad", "block", t(1)), ("x.com", "aaa", t(9)), (None, "block", t(1)), ("y.com", "block", None)], "key string, action string, listed_at timestamp")
    rows = [(d, u, t(d)) for d in range(1, 11) for u in ("http://x.com/", "http://a.x.com/q")] + [(2, "http://x.com/bad/z", t(2)), (2, "http://x.com/bad/z", t(2)), (1, None, t(1)), (1, "http://y.com", None), (1, "", t(1))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "i int, url string, fetched_at timestamp, verdict string")
    out = judge_captures(df, validity_intervals(entries)).collect()
    assert len(out) == len(rows)
    for r in out:
        d = r.i
        if r.url == "http://x.com/":
            assert r.verdict == ("block" if 3 <= d < 5 else "allow" if d >= 9 else "unlisted")
        elif r.url == "http://a.x.com/q":
            assert r.verdict == ("block" if d == 3 else "allow" if d >= 4 else "unlisted")
        elif r.url and "bad" in r.url:
            assert (r.verdict, r.list_key) == ("block", "x.com/bad")
        else:
            assert r.verdict == "unlisted"
    assert judge_captures(df.limit(0), validity_intervals(entries)).collect() == []


def test_blocks_after_unseen_elements():
    """Text after an unseen element that closes itself or is never closed stays."""

    def texts(page):
        return [b[1] for b in hb.blocks(page)]

    for tag in ("<svg class=icon/>", "<svg />", "<math/>", "<select>", "<object data=x>", "<audio src=x>", "<video>", "<canvas>", "<noscript>"):
        assert texts(f"<article><p>one {tag}</p><p>two</p></article><p>three</p>") == ["one", "two", "three"]
    for tag in ("select", "object", "audio", "video", "canvas", "noscript", "svg", "math", "template"):
        assert texts(f"<p>one <{tag}><b>no</b><p>no</p></{tag}> two</p><p>three</p>") == ["one two", "three"]
        assert texts(f"<div>one <{tag}>no</div><p>two</p><{tag}>no</{tag}><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one <noscript><div>no</noscript> two</p>") == ["one two"]
    assert texts("<p>a<textarea><p>no</p></textarea>b</p>") == ["ab"]


def test_blocks_without_end_of_head():
    """Both </head> and <body> may be left out."""
    for page in ("<html><head><title>t</title><meta charset=x><p>one</p><p>two</p>", "<head><title>t</title><noscript><img src=x></noscript></head><p>one</p><p>two</p>", "<head><title>t</title><body><p>one<p>two"):
        found = list(hb.blocks(page))
        assert [b[1] for b in found] == ["one", "two"] and all("head" not in [x[0] for x in b[0]] for b in found)


def test_blocks():
    page = """<html><head><title>t</title><style>p{}</style></head><body><script>var x="</p>";</script>
    <nav><ul><li><a href=/>Home</a><li>Two</ul></nav><!-- <p>no</p> --><article class="post main"><h1>A &amp; B</h1><p>One<br>two &nbsp; three<p>open <b>bold
    <div>inner</div> tail</article><textarea>no</textarea><p>last"""
    assert [b[1] for b in hb.blocks(page)] == ["Home", "Two", "A & B", "One two three", "open bold", "inner", "tail", "last"]
    assert list(hb.blocks("")) == [] and [b[1] for b in hb.blocks("just text")] == ["just text"]


@pytest.fixture(scope="module")
def labeller():
    return hb.fitted_labeller([f"word{k}" for k in range(2000)])


def test_labeller_on_pages_it_has_not_seen(labeller):
    rng, words, known = np.random.default_rng(77), [f"other{k}" for k in range(2000)], {}
    bad = total = 0
    for _ in range(120):
        page, main = hb.training_page(rng, words)
        found = list(hb.blocks(page))
        labels = labeller.labels([hb.vectors(found, known)])[0]
        bad += sum((b[1] in main) != x for b, x in zip(found, labels))
        total += len(found)
    assert bad <= 0.03 * total


def test_gradients():
    rng = np.random.default_rng(0)
    net = hb.BlockLabeller(hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(2, 4, hb.PATH + hb.WORDS + hb.COUNTS)) * 0.1
    mask = np.array([[1, 1, 1, 0], [1, 1, 1, 1]], np.float64)
    y = np.array([[1, 0, 1, 0], [0, 0, 1, 1]], np.float64)
    grad, _ = net.gradients(x, mask, y)
    for k in ("xf", "hf", "hb", "bb", "out"):
        at = tuple(0 for _ in net.p[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = net.gradients(x, mask, y)[1]
        net.p[k][at] = keep - 1e-3
        down = net.gradients(x, mask, y)[1]
        net.p[k][at] = keep
        assert abs((up - down) / 2e-3 - grad[k][at]) < 1e-3


def test_extraction_of_the_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(-1, "u", None), (-2, "u", "")], "page_id long, url string, html string")
    out = {r.page_id: r for r in hb.extract_main_text(pages.unionByName(extra)).collect()}
    assert out[-1].text == out[-2].text == ""
    right = 0
    for r in out.values():
        if r.html:
            body = r.html[r.html.index("<article>") : r.html.index("</article>")]
            right += r.text == "\n".join(b[1] for b in hb.blocks(body))
    assert right >= 0.9 * (len(out) - 2)


def tune(pitches, rate=4000, each=0.2):
    t = np.arange(int(rate * each)) / rate
    return np.concatenate([0.4 * np.sin(2 * np.pi * 440 * 2 ** (p / 12) * t) for p in pitches])


def test_fingerprints_align_shifted_recordings(spark):
    rng = np.random.default_rng(3)
    songs = [rng.integers(-12, 13, 60) for _ in range(4)]
    rows = []
    for k, s in enumerate(songs):
        rows.append((10 * k, chroma.write_wav(tune(s), 4000)))
        late = np.concatenate([tune(rng.integers(-12, 13, 4))[: 4 * 256 * 3], tune(s)])  # twelve hops later
        rows.append((10 * k + 1, chroma.write_wav(late + rng.normal(0, 0.003, len(late)), 4000)))
    rows += [(100, rows[0][1]), (101, None), (102, b"no wav"), (103, b""), (104, chroma.write_wav(np.zeros(100), 4000))]
    prints = spark.createDataFrame(rows, "id long, wav binary").select("id", chroma.fingerprints(F.col("wav")).alias("print"))
    out = {r.id: r for r in chroma.align_recordings(prints.cache(), F.col("id") % 10 == 0).collect()}
    assert len(out) == len(rows)
    for k in range(4):
        r = out[10 * k]
        assert r.best_match == 10 * k + 1 and abs(r.offset + 12) <= 1 and r.bit_errors < 0.3
    assert out[100].class_id == 0 and out[101].n_prints == out[102].n_prints == out[104].n_prints == 0
    assert [out[k].class_id for k in (101, 102, 103, 104)] == [101, 102, 103, 104]


def test_fingerprint_against_direct_sums():
    """The integral image gives what summing the frames gives."""
    x = np.random.default_rng(9).normal(size=4000 * 4) * 0.1
    frames = chroma.chroma_frames(x, 4000)
    got = chroma.fingerprint(x, 4000)
    wide = np.concatenate([frames, frames[:, :6]], 1)
    kind, low, high, width = chroma.FILTERS[0]
    assert kind == 0
    for at in range(0, len(got), 7):
        a = wide[at + width // 2 : at + width, low : low + high].sum()
        b = wide[at : at + width // 2, low : low + high].sum()
        level = np.searchsorted(chroma.CUTS, np.log((0.05 + max(a, 0)) / (0.05 + max(b, 0))))
        assert (int(got[at]) & 0xFFFFFFFF) >> 30 == chroma.GRAY[level]
