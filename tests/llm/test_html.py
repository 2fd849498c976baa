"""Parsing in linear time, and extraction from given, broken, repeated and very long pages."""

import time

import numpy as np
import pytest

from rulewright.llm import html_blocks as hb


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<a href='" * 120_000, "<b>x" * 260_000, "<div>x" * 170_000, '<a ">" ' * 150_000, "<select>" * 120_000 + "</select>", "<a><div>" + "<b>" * 100_000 + "</a>" * 150_000, "<!x " * 250_000, "<p>x" * 250_000, "</b>" * 250_000],
    ids=["tags without end", "open quotes", "open bold", "nested", "quoted ends", "unseen", "walls", "declarations", "paragraphs", "stray ends"],
)
def test_a_megabyte_of_anything_is_read_in_seconds(page):
    began = time.process_time()
    n = sum(1 for _ in hb.blocks(page))
    assert time.process_time() - began < 12, n


def test_depth_and_quotes():
    deep = "<div>" * 500 + "<p>in</p>" + "</div>" * 500 + "<p>out</p>"
    assert [b[1] for b in hb.blocks(deep)] == ["in", "out"]
    assert all(len(b[0]) <= hb.OUTER + hb.INNER for b in hb.blocks(deep))
    assert [b[1] for b in hb.blocks("<p title='a > b'>one</p><p title=\"x>two</p><p>three</p>")][0] == "one"
    assert [b[1] for b in hb.blocks("1 < 2 <b>and</b> 3 > 2 <")] == ["1 < 2 and 3 > 2 <"]


def test_labels_do_not_depend_on_company():
    """A page gets the same labels alone, among others and however vectors are cut."""
    labeller = hb.BlockLabeller(seed=2)
    rng = np.random.default_rng(4)
    pages = [list(hb.blocks(hb.training_page(rng, [f"w{k}" for k in range(300)])[0])) for _ in range(30)]
    alone = [labeller.label_pages([p], {})[0].tolist() for p in pages]
    assert [x.tolist() for x in labeller.label_pages(pages, {})] == alone
    hb.TOGETHER, keep = 7, hb.TOGETHER
    try:
        assert [x.tolist() for x in labeller.label_pages(pages, {})] == alone
    finally:
        hb.TOGETHER = keep
    assert [labeller.labels([hb.vectors(p, {})])[0].tolist() for p in pages] == alone


def test_given_pages_are_extracted_exactly(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    wide = pages.selectExpr("*", "'clash' as text")
    extra = spark.createDataFrame([(-1, "u", None, "x"), (-2, "u", "", "x"), (-3, "u", "<a " * 100_000, "x"), (None, None, "<p>", "x")], "page_id long, url string, html string, text string")
    both = wide.unionByName(extra).unionByName(wide.where("page_id < 5"))
    out = hb.extract_main_text(both).collect()
    assert len(out) == both.count()
    right = total = 0
    seen = {}
    for r in out:
        if r.html and "<article>" in r.html:
            body = r.html[r.html.index("<article>") : r.html.index("</article>")]
            right += r.text == "\n".join(b[1] for b in hb.blocks(body))
            total += 1
            assert seen.setdefault(r.page_id, r.text) == r.text
        elif not r.html:
            assert r.text == ""
    assert right >= 0.995 * total


def test_empty_table(spark):
    assert hb.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
