"""Sources, sinks, page extraction."""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel
from pyspark.sql import functions as F

from ..functions.vectors import as_array
from ..operators.dedup import fetch_stats, new_urls
from ..operators.groups import default_topic_names
from ..session import materialize, new_path
from ..sources import store
from ..sources.known_urls import KnownUrls
from ..sources.pages import ENTITIES, discover_urls, extract_articles, link_frontier, site_of
from .base import (
    ARTICLES,
    TOPIC_LABELS,
    WORD_VECTORS,
    TOKENS,
    articles,
    as_sql_list,
    cleaned,
    embeddings,
    pages,
    query,
    table,
    topic_labels,
    word_vectors,
)

ARTICLE_COLUMNS = "url, title, content, published_at, parse_datetime"
SITE = "lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1))"


@query("read_sources", f"SELECT DISTINCT {SITE} AS url FROM pages")
def read_sources(spark, sf):
    path = new_path(spark, "sources")
    table(spark, sf, "pages").select(site_of(F.col("url")).alias("url")).distinct().write.csv(path, header=True)
    return store.read_sources(spark, path)


@query("read_articles", f"WITH {ARTICLES} SELECT {ARTICLE_COLUMNS} FROM articles")
def read_articles(spark, sf):
    path = new_path(spark, "articles")
    store.ensure_table(spark, path, store.ARTICLES)
    store.append_articles(articles(spark, sf), path)
    return store.read_articles(spark, path)


@query(
    "append_articles",
    f"WITH {ARTICLES} SELECT {ARTICLE_COLUMNS} FROM articles UNION ALL SELECT {ARTICLE_COLUMNS} FROM articles",
)
def append_articles(spark, sf):
    path = new_path(spark, "articles")
    for _ in range(2):
        store.append_articles(articles(spark, sf), path)
    return store.read_articles(spark, path)


@query("read_rejected", "SELECT url FROM pages")
def read_rejected(spark, sf):
    path = new_path(spark, "rejected")
    store.append_rejected(table(spark, sf, "pages"), path)
    return store.read_rejected(spark, path)


@query("append_rejected", "SELECT url FROM pages UNION ALL SELECT url FROM pages")
def append_rejected(spark, sf):
    path = new_path(spark, "rejected")
    for _ in range(2):
        store.append_rejected(table(spark, sf, "pages"), path)
    return store.read_rejected(spark, path)


@query("reset_table", "SELECT 'doc://' || doc_id AS url FROM documents")
def reset_table(spark, sf):
    path = new_path(spark, "rejected")
    store.append_rejected(table(spark, sf, "pages"), path)
    store.reset_table(spark, path, store.REJECTED)
    store.append_rejected(articles(spark, sf), path)
    return store.read_rejected(spark, path)


@query(
    "write_topic_names",
    f"""WITH {TOPIC_LABELS}
    SELECT DISTINCT 0 AS level, l0 AS label, '0_' || l0 AS name FROM topic_labels
    UNION ALL SELECT DISTINCT 1, l1, '1_' || l1 FROM topic_labels""",
)
def write_topic_names(spark, sf):
    path = new_path(spark, "names")
    labels = topic_labels(spark, sf)
    names = [
        default_topic_names(labels, i, f"l{i}").select(F.lit(i).alias("level"), F.col(f"l{i}").alias("label"), "name")
        for i in (0, 1)
    ]
    store.write_topic_names(names[0].unionByName(names[1]), path)
    return spark.read.schema("label int, name string, level int").json(path)


@query("export_parquet", f"WITH {ARTICLES} SELECT {ARTICLE_COLUMNS} FROM articles")
def export_parquet(spark, sf):
    path = new_path(spark, "export")
    store.export_parquet(articles(spark, sf), path)
    return spark.read.parquet(path)


@query("stage_table", f"WITH {TOPIC_LABELS} SELECT url, l0, l1 FROM topic_labels")
def stage_table(spark, sf):
    path = new_path(spark, "labels")
    store.save_stage(topic_labels(spark, sf), path)
    return store.load_stage(spark, path)


@query("stage_model")
def stage_model(spark, sf):
    path = new_path(spark, "model")
    rows = embeddings(spark, sf)
    store.save_stage(PCA(k=8, inputCol="features", outputCol="latent").fit(rows), path)
    latent = store.load_stage(spark, path, PCAModel).transform(rows)
    return latent.select("vec_id", as_array(F.col("latent")).alias("latent"))


@query("load_word_vectors", f"WITH {TOKENS}, {WORD_VECTORS} SELECT token AS word, v1, v2, v3, v4 FROM wv")
def load_word_vectors(spark, sf):
    path = new_path(spark, "vectors")
    store.save_stage(word_vectors(cleaned(spark, sf)), path)
    loaded = store.load_word_vectors(spark, path)
    return loaded.select("word", *(F.col("vector")[i].alias(f"v{i + 1}") for i in range(4)))


def _unescape_sql(x: str) -> str:
    for entity, character in ENTITIES.items():
        x = f"replace({x}, {as_sql_list([entity])}, {as_sql_list([character])})"
    return x


def _hidden_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "footer"):
        x = rf"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return x


def visible_sql(x: str) -> str:
    x = _unescape_sql(rf"regexp_replace({_hidden_sql(x)}, '(?s)<[^>]+>', ' ', 'g')")
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_PARAGRAPHS = rf"array_to_string(regexp_extract_all({_hidden_sql('html')}, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), ' ')"
EXTRACTED = f"""extracted AS (
    SELECT url, CASE WHEN body IS NOT NULL THEN title END AS title, body AS content FROM (
        SELECT url, {visible_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
            coalesce(nullif({visible_sql("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)")}, ''),
                nullif({visible_sql("regexp_extract(html, '(?is)<main[^>]*>(.*)</main>', 1)")}, ''),
                nullif({visible_sql(_PARAGRAPHS)}, '')) AS body FROM pages))"""
# the file endings of pages.NOT_PAGES
IS_PAGE = r"""url IS NOT NULL AND NOT regexp_matches(url,
    '(?i)\.(css|js|json|xml|rss|atom|png|jpe?g|gif|svg|ico|webp|pdf|zip|mp3|mp4)([?].*)?$')"""
LINKS = rf"""links AS (
    SELECT DISTINCT lower(site) AS site, CASE
        WHEN regexp_matches(href, '^https?://') THEN href
        WHEN starts_with(href, '//') THEN regexp_extract(site, '^([a-zA-Z]+:)', 1) || href
        WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
        WHEN starts_with(href, '/') THEN site || href ELSE site || '/' || href END AS url
    FROM (SELECT regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS site,
        unnest(regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"''#]+)', 1)) AS href FROM pages)),
candidates AS (SELECT site, url FROM links WHERE {IS_PAGE}
    UNION ALL SELECT {SITE} AS site, url FROM pages)"""


@query(
    "extract_articles",
    f"WITH {EXTRACTED} SELECT url, title, content, CAST(NULL AS VARCHAR) AS published_at, "
    "'2024-01-01 00:00:00' AS parse_datetime FROM extracted",
)
def extracted_articles(spark, sf):
    return extract_articles(pages(spark, sf), F.lit("2024-01-01 00:00:00"))


@query("discover_urls", f"WITH {LINKS} SELECT site, url FROM links WHERE {IS_PAGE}")
def discovered_urls(spark, sf):
    return discover_urls(pages(spark, sf))


FRONTIER = rf"""WITH RECURSIVE page_links AS (
    SELECT DISTINCT page, url FROM (
        SELECT url AS page, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href AS url
        FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["'']([^"''#]+)', 1)) AS href FROM pages)
        WHERE href LIKE '/%') WHERE {IS_PAGE}),
reached(url, depth) AS (
    SELECT url, 0 FROM pages WHERE page_id % 3 > 0
    UNION SELECT l.url, depth + 1 FROM reached r JOIN page_links l ON l.page = r.url WHERE depth < 3)
SELECT url, CAST(min(depth) AS INTEGER) AS depth, url IN (SELECT url FROM pages) AS stored FROM reached GROUP BY url"""


@query("link_frontier", FRONTIER)
def frontier(spark, sf):
    starts = table(spark, sf, "pages").where("page_id % 3 > 0").select("url")
    return link_frontier(pages(spark, sf), starts)


def _candidates(spark, sf):
    rows = pages(spark, sf)
    return discover_urls(rows).unionByName(rows.select(site_of(F.col("url")).alias("site"), "url"))


@query(
    "new_urls",
    f"WITH {LINKS} SELECT site, url FROM candidates WHERE url NOT IN (SELECT url FROM pages)",
)
def new_urls_of_links(spark, sf):
    return new_urls(_candidates(spark, sf), pages(spark, sf))


@query(
    "known_urls",
    f"WITH {LINKS} SELECT site, url FROM candidates WHERE url NOT IN (SELECT url FROM pages)",
)
def unknown_links(spark, sf):
    known = KnownUrls(spark, new_path(spark, "known"), 8)
    known.add(pages(spark, sf))
    # read twice, for their distinct urls and as rows
    return known.unknown(materialize(_candidates(spark, sf), name="candidates"))


@query(
    "fetch_stats",
    f"""WITH {LINKS}, known AS (SELECT DISTINCT url, 1 AS k FROM pages)
    SELECT site, count(*) AS all_urls, count(k) AS ignored, count(*) - count(k) AS new_urls
    FROM candidates LEFT JOIN known USING (url) GROUP BY site""",
)
def fetch_stats_of_sites(spark, sf):
    return fetch_stats(_candidates(spark, sf), pages(spark, sf))


@query(
    "urls_to_ignore",
    "SELECT 'doc://' || doc_id AS url FROM documents UNION ALL SELECT url FROM pages",
)
def ignore_list(spark, sf):
    return store.urls_to_ignore(articles(spark, sf), pages(spark, sf))
