"""Links, article text and the frontier of stored pages."""

from urllib.parse import urljoin, urldefrag

import pytest
from pyspark.sql import functions as F

from topicflow.sources import pages as P

BASES = ["http://S.com/news/a/i.html", "http://s.com", "https://s.com/a/b/?q=1", "https://s.com/x?u=/y/z"]
LINKS = ["b.html", "../c", "../../../c", "./d/", "?p=2&q=1", "/x", "/x/../y/./z", "//t.org/k", "e/..", ".", "x#f", "k?a=../b"]


def test_links_resolve_as_a_browser_does(spark):
    df = spark.createDataFrame([(b, x) for b in BASES for x in LINKS], "base string, link string")
    for r in df.withColumn("url", P.resolve_url(F.col("base"), F.col("link"))).collect():
        base = r.base if r.base.count("/") > 2 else r.base + "/"
        assert r.url == urldefrag(urljoin(base, r.link)).url, (r.base, r.link)
    whole = spark.createDataFrame([("http://u.org/a/../b",)], "link string")
    assert whole.select(P.resolve_url(F.lit(BASES[0]), F.col("link"))).first()[0] == "http://u.org/b"
    other = spark.createDataFrame([(x,) for x in ("", "#top", "mailto:a@b.c", "javascript:x()")], "link string")
    assert {r[0] for r in other.select(P.resolve_url(F.lit(BASES[0]), F.col("link"))).collect()} == {None}


def links(spark, url, html):
    found = P.discover_urls(spark.createDataFrame([(url, html)], "url string, html string"))
    return {(r.site, r.url) for r in found.collect()}


def test_links_of_a_page(spark):
    html = "<a href='b.html'>x</a> <a class=k href=\"?p=2&amp;q=1\">y</a><A HREF=/x>z</A><a href=\"s.css\">n</a><a href='#t'>n</a><a name=q>n</a>"
    site = "http://s.com"
    assert links(spark, "http://S.com/news/a/i.html", html) == {
        (site, "http://S.com/news/a/b.html"), (site, "http://S.com/news/a/i.html?p=2&q=1"), (site, "http://S.com/x")
    }
    based = '<base target="_top" href="/deep/er/"><a href="b">x</a>'
    assert links(spark, "http://s.com/i", based) == {(site, "http://s.com/deep/er/b")}


def content(spark, html):
    rows = P.extract_articles(spark.createDataFrame([("u", html)], "url string, html string"), F.lit("2024-01-01"))
    return rows.first().content


PROSE = "This is a long enough sentence of plain words that reads like the body of an article. "


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<article>a</article><div>ad</div><article class=x>b</article>", "a b"),
        (f"<div><a href=/1>home page</a> <a href=/2>more news here</a></div><div>{PROSE}</div><div>{PROSE}</div><div>contact</div>", (PROSE * 2).strip()),
        (f"<td>{PROSE}</td><ul>" + "<li><a href=/k>one more link to read</a></li>" * 9 + f"</ul><div>{PROSE}<b>more</b> {PROSE}</div>", f"{PROSE}more {PROSE}".strip()),
        ("<ul><li><a href=/k>only</a></li><li>menu</li></ul>", None),
        ("", None),
    ],
)
def test_article_text(spark, html, expected):
    assert content(spark, html) == expected


def test_frontier_equals_a_search(spark):
    graph = {"http://s.com/": ["a", "b"], "http://s.com/a": ["c", "/"], "http://s.com/b": ["c", "gone"], "http://s.com/c": ["d"], "http://s.com/d": ["e"]}
    rows = [(u, "".join(f"<a href='{x}'>k</a>" for x in own)) for u, own in graph.items()]
    df = spark.createDataFrame(rows, "url string, html string")
    starts = spark.createDataFrame([("http://s.com/",)] * 2, "url string")
    depth, todo = {"http://s.com/": 0}, ["http://s.com/"]
    for url in todo:
        for x in graph.get(url, []):
            found = urljoin(url, x)
            if found not in depth:
                depth[found] = depth[url] + 1
                todo.append(found)
    for rounds in (1, 2, 9):
        expected = {(u, d, u in graph) for u, d in depth.items() if d <= rounds}
        assert {tuple(r) for r in P.link_frontier(df, starts, rounds).collect()} == expected
    assert P.link_frontier(df, starts.limit(0)).collect() == []


def test_a_link_is_resolved_once(spark):
    pages = spark.createDataFrame([("http://a.b/c/d", '<a href="../x?p=1&amp;q=2"><a href=y.css><a href="/&#228;">')], "url string, html string")
    found = P.page_links(pages)
    assert sorted(r.url for r in found.collect()) == ["http://a.b/x?p=1&q=2", "http://a.b/ä"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # a filter on the rows would hold the resolving expression again, once per condition
    assert plan.count("Filter") == 0 and plan.count("Generate") == 1
