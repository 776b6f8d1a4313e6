"""Articles and links from stored web pages, by built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_ws
from ..session import materialize

# Named entities and their characters, the ampersand last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ",
    "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&amp;": "&",
}
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
ARTICLE = r"(?is)<article[^>]*>(.*?)</article>"
MAIN = r"(?is)<main[^>]*>(.*)</main>"
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
NUMERIC = r"&#(\d{1,7});"
HEXADECIMAL = r"(?i)&#x([0-9a-f]{1,6});"
COMMENT = r"(?s)<!--.*?-->"
HIDDEN = tuple(rf"(?is)<{tag}[^>]*>.*?</{tag}>" for tag in ("script", "style", "nav", "footer"))
TAG = r"(?s)<[^>]+>"
# links that a reader can follow; style sheets and feeds are in other tags
HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
BASE = r"(?is)<base\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
# where a page without marked text is cut into blocks, and what a block costs in words
BLOCK = r"(?is)</?(?:div|p|section|aside|header|table|tr|td|th|ul|ol|li|h[1-6]|form|br|hr|body)(?:\s[^>]*)?/?>"
LINK = r"(?is)<a\s[^>]*>(.*?)</a>"
BLOCK_COST = 8
# files that are no pages
NOT_PAGES = r"(?i)\.(css|js|json|xml|rss|atom|png|jpe?g|gif|svg|ico|webp|pdf|zip|mp3|mp4)([?].*)?$"
SITE = r"^([a-zA-Z]+://[^/?#]+)"


def _characters(col: Column, pattern: str, base: int, mark: str) -> Column:
    """Numeric entities as the characters they name; those that name none stay."""
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)))

    def put(text: Column, digits: Column) -> Column:
        code = F.conv(digits, base, 10).cast("long")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        point = F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32))), 8, "0")
        entity = F.concat(F.lit(mark), digits, F.lit(";"))
        return F.when(valid, F.replace(text, entity, F.decode(F.unhex(point), "UTF-32"))).otherwise(text)

    return F.when(F.contains(col, F.lit("&#")), F.aggregate(found, col, put)).otherwise(col)


def unescape(col: Column) -> Column:
    """Entities as their characters; a text without an ampersand is looked at once."""

    def resolved(text: Column) -> Column:
        # the ampersand last, so that what it uncovers is not resolved again
        named = text
        for entity, character in ENTITIES.items():
            if entity != "&amp;":
                named = F.replace(named, F.lit(entity), F.lit(character))
        decimal = _let(named, lambda t: _characters(t, NUMERIC, 10, "&#"))
        numeric = _let(decimal, lambda t: _characters(t, HEXADECIMAL, 16, "&#x"))
        return F.when(F.contains(text, F.lit("&")), F.replace(numeric, F.lit("&amp;"), F.lit("&"))).otherwise(text)

    return _let(col, resolved)


def without_hidden(html: Column) -> Column:
    text = F.regexp_replace(html, COMMENT, " ")
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, " ")
    return text


def visible_text(html: Column) -> Column:
    """Text of a fragment without hidden parts and tags, entities resolved, single spaces."""
    return normalize_ws(unescape(F.regexp_replace(without_hidden(html), TAG, " ")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def densest_text(html: Column) -> Column:
    """The text of the run of blocks with the most words outside links, for pages that mark none.

    Each block counts its words, less twice those in links and a constant, so that menus and captions
    count against a run; the first of equal runs is taken, and a page of such blocks only gives an empty text.
    """
    cut = F.split(F.regexp_replace(without_hidden(html), BLOCK, "\u0001"), "\u0001")

    def measured(block: Column) -> Column:
        text = normalize_ws(unescape(F.regexp_replace(block, TAG, " ")))
        links = normalize_ws(F.regexp_replace(F.array_join(F.regexp_extract_all(block, F.lit(LINK), F.lit(1)), " "), TAG, " "))
        cost = 2 * _words(links) + BLOCK_COST
        return _let(text, lambda t: F.named_struct(F.lit("text"), t, F.lit("score"), (_words(t) - cost).cast("long")))

    names = ["at", "start", "sum", "from", "to", "best"]
    state = lambda *values: F.named_struct(*(x for v, n in zip(values, names) for x in (F.lit(n), v.cast("long"))))

    def step(s: Column, block: Column) -> Column:
        fresh = s["sum"] <= 0  # a run that is worth nothing is not carried on
        start = F.when(fresh, s["at"]).otherwise(s["start"])
        total = F.greatest(s["sum"], F.lit(0)) + block["score"]
        better = total > s["best"]
        keep = lambda new, old: F.when(better, new).otherwise(old)
        return state(s["at"] + 1, start, total, keep(start, s["from"]), keep(s["at"], s["to"]), keep(total, s["best"]))

    zero, none = F.lit(0), F.lit(-1)

    def chosen(blocks: Column) -> Column:
        best = F.aggregate(blocks, state(zero, zero, zero, zero, none, zero), step)
        run = _let(best, lambda s: F.slice(blocks, (s["from"] + 1).cast("int"), (s["to"] - s["from"] + 1).cast("int")))
        return F.array_join(F.filter(F.transform(run, lambda b: b["text"]), lambda t: t != ""), " ")

    return _let(F.transform(cut, measured), chosen)


def extract_articles(pages: DataFrame, parse_datetime: Column) -> DataFrame:
    """(url, html) → article rows; a page without article text has null title and content.

    The text is that of all ``<article>`` elements, without one that of ``<main>``, without either that of
    all paragraphs outside hidden parts, without a paragraph the page's densest run of blocks.
    """
    articles = F.regexp_extract_all("html", F.lit(ARTICLE), F.lit(1))
    paragraphs = F.regexp_extract_all(without_hidden(F.col("html")), F.lit(PARAGRAPH), F.lit(1))
    found = [
        visible_text(F.array_join(articles, " ")),
        visible_text(F.regexp_extract("html", MAIN, 1)),
        visible_text(F.array_join(paragraphs, " ")),
        densest_text(F.col("html")),
    ]
    title = visible_text(F.regexp_extract("html", TITLE, 1))
    return pages.select(
        "url",
        title.alias("title"),
        F.coalesce(*(F.nullif(f, F.lit("")) for f in found)).alias("content"),
        F.lit(None).cast("string").alias("published_at"),
        parse_datetime.cast("string").alias("parse_datetime"),
    ).withColumn("title", F.when(F.col("content").isNotNull(), F.col("title")))


def site_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SITE, 1))


def _unquoted(value: Column) -> Column:
    return F.trim(unescape(F.regexp_replace(value, r"^[\"']|[\"']$|[\r\n\t]", "")))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` does not lead above the root."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)

    def step(kept: Column, segment: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.array_append(kept, segment))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(closed, "/")).otherwise(path)


def resolve_url(base: Column, link: Column) -> Column:
    """The absolute url of a link on a page at ``base``, without its fragment; null for an empty link and
    for what is not fetched over http."""
    def joined(v: Column) -> Column:
        base, link = v["base"], v["link"]
        site = F.regexp_extract(base, SITE, 1)
        path = F.coalesce(F.nullif(F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
        folder = F.regexp_replace(path, "[^/]*$", "")
        return (
            F.when(link == "", F.lit(None))
            .when(link.rlike(r"^(?i)https?://"), link)
            .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), link))
            .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link.startswith("?"), F.concat(site, path, link))
            .otherwise(F.concat(site, folder, link))
        )

    def clean(url: Column) -> Column:
        part = lambda i: F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]*)([^?]*)(.*)$", i)
        return F.concat(part(1), _let(part(2), without_dots), part(3))

    given = F.named_struct(F.lit("base"), base, F.lit("link"), F.regexp_replace(link, "#.*$", ""))
    return _let(_let(given, joined), clean)


def page_links(pages: DataFrame) -> DataFrame:
    """(page, site, url) of the links on each page, files that are no pages left out.

    Relative links are resolved against ``<base>`` or the page's own address; entities are resolved,
    links may stand without quotes.  Links are resolved inside their page's array: a filter on rows
    would resolve each of them again.
    """
    given = _unquoted(F.regexp_extract("html", BASE, 1))
    base = F.coalesce(resolve_url(F.col("url"), given), F.col("url"))
    links = F.regexp_extract_all("html", F.lit(HREF), F.lit(1)).alias("links")
    rows = pages.select(F.col("url").alias("page"), site_of(F.col("url")).alias("site"), base.alias("base"), links)
    urls = F.transform("links", lambda link: resolve_url(F.col("base"), _unquoted(link)))
    found = F.filter(urls, lambda url: url.isNotNull() & ~url.rlike(NOT_PAGES))
    return rows.select("page", "site", F.explode(found).alias("url"))


def discover_urls(pages: DataFrame) -> DataFrame:
    """Distinct (site, url) of the links to pages on each site's pages."""
    return page_links(pages).select("site", "url").distinct()


def link_frontier(pages: DataFrame, starts: DataFrame, rounds: int = 3) -> DataFrame:
    """(url, depth, stored): what is reached from the urls of ``starts`` over stored pages in ``rounds`` steps.

    Each round joins the urls found last with the links of their pages and leaves out, by an anti join,
    what was visited before; it is written as a table.  Urls whose page is not stored are the ones to
    fetch; they are reached, not followed.
    """
    links = materialize(page_links(pages).select("page", "url").distinct(), name="links")
    last = materialize(starts.select("url").distinct().withColumn("depth", F.lit(0)), name="frontier")
    visited = last
    for depth in range(1, rounds + 1):
        reached = last.join(links.withColumnRenamed("url", "found"), F.col("url") == F.col("page")).select(F.col("found").alias("url"))
        new = reached.distinct().join(visited.select("url"), "url", "left_anti")
        last = materialize(new.withColumn("depth", F.lit(depth)), name="frontier")
        if last.isEmpty():
            break
        visited = visited.union(last)
    stored = pages.select("url").distinct().withColumn("_stored", F.lit(True))
    return visited.join(stored, "url", "left").select("url", "depth", F.col("_stored").isNotNull().alias("stored"))
