"""Elements that hold others of their own name."""

import pytest
from pyspark.sql import functions as F

from bibflow.functions.listing import element, items, outermost
from bibflow.sources.listing import read_items, read_listing


def values(spark, html, column):
    return spark.createDataFrame([(html,)], "html STRING").select(column(F.col("html")).alias("v")).first()["v"]


@pytest.mark.parametrize("html,want", [
    ("<b>x</b>", ["x"]), ("<b>x<b>y</b>z</b>w<b a='1'>v</b>", ["x<b>y</b>z", "v"]), ("</b><b>x</b>", ["x"]), ("<b/><b>x<b/>y</b>", ["", "x<b/>y"]),
    ("<b>x<b>y</b>", []), ("<br>x<b >y</b >", ["y"]), ("", []), ("<b><i></b></i>", ["<i>"]), (None, None),
    ("<b>" * 200 + "x" + "</b>" * 200, ["<b>" * 199 + "x" + "</b>" * 199]),
])
def test_outermost(spark, html, want):
    assert values(spark, html, lambda h: outermost(h, "b")) == want


@pytest.mark.parametrize("html,want", [
    ('<p><b class="k">x<b>y</b>z</b>w</b>', "x<b>y</b>z"), ('<b><b class="k">x</b>y</b>', "x"), ('<b class="k">x<b>y</b>', "x<b>y"),
    ('<b class="k">x', None), ("<b>x</b>", None), (None, None), ('<b class="k">x</b><b class="k">y</b>', "x"),
])
def test_element_ends_at_its_own_closing_tag(spark, html, want):
    assert values(spark, html, lambda h: element(h, "b", class_="k")) == want


def test_long_elements_take_no_stack(spark):
    body = "<b>x </section" * 100_000
    assert values(spark, f'<section role="k">{body}</section >y</section>', lambda h: element(h, "section", role="k")) == body


def test_items_end_at_their_own_closing_tag(spark):
    start = '<li class="search__item issue-item-container">'
    html = f"<ul>{start}a<ul><li>b</li></ul></li>\n{start}c</li></ul>footer<li>d</li>"
    assert values(spark, html, items) == ["a<ul><li>b</li></ul>", "c"]
    assert values(spark, f"{start}a{start}b</li>", items) == ["a", "b"]


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, "https://x", "<li></li>")], "page_id BIGINT, url STRING, html STRING")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "hlFld" in plan(read_items(pages))
    assert "hlFld" not in plan(read_listing(pages, pages))  # the join works on written items
