import re

import corpus_pipeline
from rulewright.llm.common import stored

COLUMNS = set(corpus_pipeline.COLUMNS)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, sf), "stage")
        rows = out.collect()
        assert rows
        if n + 1 < len(corpus_pipeline.STAGES):
            assert set(out.columns) == COLUMNS
            assert all(before[r.doc_id] == r.text for r in rows)
        if name == "near duplicates":
            sets = []
            for r in rows:
                w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
                sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
            for i, a in enumerate(sets):
                for b in sets[:i]:
                    assert 10 * len(a & b) < 8 * len(a | b)
        if name == "encoding":
            assert len(rows) == docs.count() and all(len(r.ids) == r.n_tokens for r in rows)
        docs = out


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
    assert docs.count() == 0


def test_odd_rows(spark, sf):
    """Null ids and texts, repeated rows and columns named like results: no stage fails, and what each keeps is as stated."""
    text = " ".join(f"plain{k * k % 97} word{k}" for k in range(40))
    other = " ".join(f"other{k * 7 % 89} thing{k}" for k in range(60))
    rows = [(1, text, "en", "a", 1, True, 5), (1, text, "en", "a", 1, True, 5), (2, text + " tail", "en", "a", 1, True, 5), (None, other, None, None, None, None, None), (3, None, "en", "a", 0, True, 5), (4, "", "en", "b", 0, True, 5), (5, other, "en", None, 1, False, 5), (6, "few words", "en", "b", 1, False, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int")
    kept = stored(corpus_pipeline.quality(spark, docs, sf), "stage")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2, 5] and set(kept.columns) == COLUMNS
    one = stored(corpus_pipeline.near_duplicates(spark, kept, sf), "stage")
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 5] and set(one.columns) == COLUMNS
    mixed = stored(corpus_pipeline.mixing(spark, one, sf), "stage")
    assert set(mixed.columns) == COLUMNS and mixed.count() > 0
    out = corpus_pipeline.encoding(spark, mixed, sf).collect()
    assert len(out) == mixed.count() and all(r.n_tokens == len(r.ids) for r in out)


def test_mixing_and_quality_against_brute_force(spark, sf):
    """The mix holds each document as often as it is taken, and quality keeps what passes base rule and list."""
    from rulewright.llm.mixing import mix_sources
    from rulewright.llm.quality_rules import quality_verdicts

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    times = {}
    for r in corpus_pipeline.mixing(spark, docs, sf).select("doc_id").collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {k: n for k, n in taken.items() if n}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_verdicts(docs, labels).collect()
    assert kept == {r.doc_id for r in judged if r.kept}
    for r in judged:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)
