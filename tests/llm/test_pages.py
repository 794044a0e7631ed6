"""HTML extraction without helpful names, on hostile markup and on odd tables."""

import re
import time

import pytest

from arborspark.llm import html_extraction
from tests.llm.test_llm import SF

PAGES = "page_id long, url string, html string"


def unnamed(page):
    return re.sub(r"\s(class|id|role)=\"[^\"]*\"", "", page)


def undone(page, names):
    return re.sub(rf"(</?)({names})\b", r"\1div", page)


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


@pytest.mark.parametrize("change", [lambda p: undone(p, "article|main"), unnamed, lambda p: undone(unnamed(p), "article|main"), lambda p: undone(unnamed(p), "article|main|nav|footer|header|aside")])
def test_densities_find_the_article_without_names(pages, change):
    whole = [html_extraction.main_text(p) for p in pages]
    bare = [html_extraction.main_text(change(p)) for p in pages]
    assert sum(a == b for a, b in zip(whole, bare)) >= 0.95 * len(pages)
    assert sum(abs(len(a) - len(b)) for a, b in zip(whole, bare)) <= 0.01 * sum(map(len, whole))


def test_second_pass_decides_short_blocks():
    long = "This is the text of the page, and it is as long as a block has to be for its stop words to decide that it is a part of the content."
    page = f"<div><a href=/>Home</a></div><div>Save now on all</div><div><h2>A head</h2><p>{long}</p><p>Short.</p><p>{long}</p></div><div>More to buy</div><div><a href=/x>Next</a> <a href=/y>Last</a></div>"
    assert html_extraction.main_text(page) == f"A head\n{long}\nShort.\n{long}"


def test_names_of_parts_inside_an_article():
    body = "The text of the article is here, and it is long enough to be one of the blocks that are decided by the words in it."
    page = f"<article><div class='post-header'><h1>Head</h1></div><p>{body}</p><div class='share'>Tell your friends of it</div><div class='tags'>one two</div></article><div class='search'>Find</div>"
    assert html_extraction.main_text(page) == f"Head\n{body}\none two"


@pytest.mark.parametrize("page", ["<b " * 300_000, "<div>" * 40_000 + "</p>" * 40_000, "<b>" + "<div>" * 30_000 + "</b>" * 30_000, "<div>" + "<b>" * 30_000 + "<p>x" * 30_000, "<div class=ad>x" * 30_000, '<a href="' * 100_000, "<!--" * 100_000, "<script>" * 100_000, "<x '" * 100_000, "<p>word " * 100_000, "x" * 3_000_000, "<svg " * 100_000 + ">"])
def test_hostile_markup_takes_linear_time(page):
    began = time.process_time()
    html_extraction.main_text(page)
    assert time.process_time() - began < 5


def test_odd_pages(spark):
    rows = [(1, "a", None), (1, "a", None), (None, None, "<p>x"), (2, "b", ""), (3, "c", "<article><p>Caf&eacute; &#x41;&nbsp;b</p>"), (3, "c", "<article><p>Caf&eacute; &#x41;&nbsp;b</p>")]
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "'z' as text", "1 as n_chars")
    got = sorted(map(tuple, html_extraction.extract(table).collect()), key=str)
    assert got == sorted([(1, "a", "", 0), (1, "a", "", 0), (None, None, "", 0), (2, "b", "", 0), (3, "c", "Café A b", 8), (3, "c", "Café A b", 8)], key=str)
    assert html_extraction.extract(spark.createDataFrame([], PAGES)).count() == 0
    long = "The blocks of this page are as long as those of the others, and there are many of them. " * 3
    big = "<article>" + f"<p>{long}</p>" * 5000 + "</article>"
    assert html_extraction.extract(spark.createDataFrame([(1, "a", big)], PAGES)).first()["text"] == "\n".join([long.strip()] * 5000)


def test_whole_table_equals_each_page_alone(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_extraction.op6_query(spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: html_extraction.main_text(h) for i, h in rows.items()}
