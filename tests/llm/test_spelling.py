"""Spelling variants against a brute-force version."""

import re
import zlib
from collections import Counter

from rulewright.llm import spelling
from rulewright.llm.queries import QUERIES, table

LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=7):
    counts = Counter()
    for ident, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if ident is None else ident}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    # Words with one place left out, to find the near ones quickly; ``near`` decides.
    by = {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) < 200 else {w[:50], w[-50:]}:
            by.setdefault(k, set()).add(w)
    form, n_near = {}, {}
    for w in words:
        found = {v for k in ({w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} if len(w) < 200 else {w[:50], w[-50:]}) for v in by[k] if near(v, w)}
        n_near[w] = len(found)
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, n_near[w], form.get(w), words.get(form.get(w)), root))
    return out


def got(df):
    rows = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark, sf, monkeypatch):
    """Many small parts, so that nodes cross from part to part."""
    monkeypatch.setattr(spelling, "PART", 900)
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(QUERIES["op11_spelling"](spark, sf)) == want and any(r[3] for r in want)


def test_hard_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 4)
    long = "ab" * 30_000
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaaa", "Éaaaaaaa", "éaaaaaaa", "bookkeeper", "bokkeeper", "bookeeper", "bookkeepers", "bookkeepes", "xookkeeper", "Straße×ß", "straße÷ß", long, long + "c", "abcdefg", "abcdef", "zabcdefg", "abcdefgz", "abXdefg"]
    rows = [(k, " ".join(w for j, w in enumerate(words) for _ in range(2 + (j * 7 + k) % 5))) for k in range(3)]
    rows += [(None, "aaaaaaa " * 200 + "aaaaaaaa " * 30), (None, None), (7, ""), (7, ""), (8, "1 2 3"), (1, rows[1][1])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, word string")
    assert got(spelling.variant_groups(df)) == brute(rows)


def test_chain_and_ties(spark):
    """a is near b is near c, each ten times as frequent; and two forms as frequent as each other."""
    monotone = {"chainwaaa": 2, "chainwaab": 20, "chainwabb": 200, "chainwbbb": 2000, "tiewordx": 2, "tiewordxa": 40, "tiewordxb": 40}
    words = spark.createDataFrame(list(monotone.items()), "word string, n long")
    known, near_ = spelling.near_words(words)
    name = {r.ident: r.word for r in known.collect()}
    found = {name[r.ident]: (r.n_near, r.best_n, name[r.best]) for r in near_.collect()}
    assert found["tiewordx"] == (2, 40, "tiewordxa") and found["chainwaab"] == (2, 200, "chainwabb")
    links = spark.createDataFrame([(k, k + 1) for k in range(37)] + [(100, 5)], "ident long, form long")
    assert {(r.ident, r.root) for r in spelling.last_forms(links).collect()} == {*((k, 37) for k in range(37)), (100, 37)}


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(none).collect() == []
    assert spelling.variant_groups(spark.createDataFrame([(1, None), (2, "so few")], "doc_id long, text string")).collect() == []
