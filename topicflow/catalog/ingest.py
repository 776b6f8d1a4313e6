"""Duplicates, language, fresh rows, and the ingest job as batch and as stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dedup import (
    distinct_of_columns,
    distinct_texts,
    drop_all_duplicates,
    drop_failed,
    flatten_batches,
    fresh_since,
)
from ..operators.lang import SLOTS, SMOOTHING, detect_language, fit_language_profiles, select_language
from ..plans.ingest import ingest, ingest_sites
from ..session import new_path, spread_scan
from ..sources import store
from ..sources.known_urls import KnownUrls
from ..sources.pages import site_of
from ..streaming.ingest import ingest_stream
from .base import ARTICLES, LANGUAGES, articles, pages, query, table
from .tables import EXTRACTED, LINKS

COUNTED = """counted AS (
    SELECT *, count(*) OVER (PARTITION BY sha256(coalesce(content, 'None'))) AS copies FROM articles)"""


@query(
    "fresh_articles",
    f"WITH {ARTICLES} SELECT url, parse_datetime FROM articles "
    "WHERE CAST(parse_datetime AS TIMESTAMP) >= TIMESTAMP '2024-01-01 02:00:00'",
)
def fresh_articles(spark, sf):
    return fresh_since(articles(spark, sf), "2024-01-01 02:00:00").select("url", "parse_datetime")


@query(
    "fresh_of_the_store",
    f"WITH {ARTICLES} SELECT url, parse_datetime FROM articles "
    "WHERE CAST(parse_datetime AS TIMESTAMP) >= TIMESTAMP '2024-01-03 02:00:00'",
)
def fresh_of_the_store(spark, sf):
    path = new_path(spark, "articles")
    store.ensure_table(spark, path, store.ARTICLES)
    store.append_articles(articles(spark, sf), path)
    since = "2024-01-03 02:00:00"
    return fresh_since(store.read_articles(spark, path, since), since).select("url", "parse_datetime")


@query(
    "flatten_batches",
    r"""SELECT url, line FROM (
        SELECT 'doc://' || doc_id AS url, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''""",
)
def flattened(spark, sf):
    lines = F.filter(F.split("content", "\n"), lambda x: x != "")
    batches = articles(spark, sf).select(
        F.transform(lines, lambda x: F.struct(F.col("url").alias("url"), x.alias("line"))).alias("batch")
    )
    return flatten_batches(batches)


@query(
    "drop_failed",
    """SELECT 'doc://' || doc_id AS url, CASE WHEN quality = 0 THEN 'rejected' ELSE 'kept' END AS status
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def without_failed(spark, sf):
    # a low quality label stands for a failed download
    labels = table(spark, sf, "labels").select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), "quality"
    )
    rows = articles(spark, sf).join(labels, "url", "left")
    rows = rows.withColumn("content", F.when(F.coalesce("quality", F.lit(1)) != 0, F.col("content")))
    kept, rejected = drop_failed(rows)
    return kept.select("url", F.lit("kept").alias("status")).unionByName(
        rejected.select("url", F.lit("rejected").alias("status"))
    )


@query(
    "drop_all_duplicates",
    f"""WITH {ARTICLES}, {COUNTED}
    SELECT url, CASE WHEN copies = 1 THEN content END AS content,
        CASE WHEN copies = 1 THEN 'kept' ELSE 'rejected' END AS status FROM counted""",
)
def deduplicated(spark, sf):
    kept, rejected = drop_all_duplicates(articles(spark, sf))
    return kept.select("url", "content", F.lit("kept").alias("status")).unionByName(
        rejected.select("url", F.lit(None).cast("string").alias("content"), F.lit("rejected").alias("status"))
    )


@query(
    "fresh_unique_per_source",
    f"""WITH {ARTICLES}, fresh AS (
        SELECT * FROM articles WHERE CAST(parse_datetime AS TIMESTAMP) >= TIMESTAMP '2024-01-01 00:00:00'),
    copies AS (SELECT sha256(coalesce(content, 'None')) AS h FROM fresh GROUP BY h HAVING count(*) = 1)
    SELECT title, count(*) AS articles FROM fresh
    WHERE sha256(coalesce(content, 'None')) IN (SELECT h FROM copies) AND content IS NOT NULL GROUP BY title""",
)
def fresh_unique_per_source(spark, sf):
    kept, _ = drop_all_duplicates(fresh_since(articles(spark, sf), "2024-01-01 00:00:00"))
    return drop_failed(kept)[0].groupBy("title").agg(F.count("*").alias("articles"))


@query("distinct_texts", "SELECT DISTINCT text AS content FROM documents")
def distinct_contents(spark, sf):
    return distinct_texts(articles(spark, sf))


@query("distinct_of_columns", "SELECT role AS text FROM conversations UNION SELECT text FROM conversations")
def distinct_union(spark, sf):
    return distinct_of_columns(table(spark, sf, "conversations"), "role", "text")


def _grams(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_letters AS (SELECT {key}, string_split(' ' || trim(regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM {source}),
{name}_chars AS (SELECT {key}, unnest(c) AS c, generate_subscripts(c, 1) AS i, len(c) AS n FROM {name}_letters),
{name}_codes AS (SELECT {key}, i, n, CAST(unicode(c) AS BIGINT) AS c0,
    lead(CAST(unicode(c) AS BIGINT), 1) OVER (PARTITION BY {key} ORDER BY i) AS c1,
    lead(CAST(unicode(c) AS BIGINT), 2) OVER (PARTITION BY {key} ORDER BY i) AS c2 FROM {name}_chars),
{name} AS (SELECT {key}, ((c0 * 1021 + c1) * 1021 + c2) % {SLOTS} AS slot FROM {name}_codes WHERE i <= n - 2)"""


PROFILES = f"""{_grams('doc_grams', 'documents', 'doc_id', 'text')},
counts AS (SELECT lang, slot, count(*) AS n FROM doc_grams JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang, slot),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
profiles AS (SELECT lang, slot, ln((coalesce(n, 0) + {SMOOTHING}) / (total + {SMOOTHING} * {SLOTS})) AS log_p
    FROM (SELECT lang, total, unnest(range({SLOTS})) AS slot FROM totals) LEFT JOIN counts USING (lang, slot))"""


def _detected(grams: str, key: str) -> str:
    return f"""sums AS (SELECT {key}, lang, sum(log_p) AS s FROM {grams} JOIN profiles USING (slot) GROUP BY {key}, lang),
detected AS (SELECT {key}, arg_max(lang, s) AS language, 1 / sum(exp(s - best)) AS score
    FROM sums JOIN (SELECT {key}, max(s) AS best FROM sums GROUP BY {key}) USING ({key}) GROUP BY {key})"""


def profiles(spark, sf):
    labelled = spread_scan(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    return fit_language_profiles(labelled, LANGUAGES, "text")


@query(
    "detect_language",
    f"WITH {PROFILES}, {_detected('doc_grams', 'doc_id')} "
    "SELECT 'doc://' || doc_id AS url, language, round(score, 4) AS score FROM detected",
)
def detected(spark, sf):
    return detect_language(articles(spark, sf), profiles(spark, sf), LANGUAGES).select(
        "url", "language", F.round("score", 4).alias("score")
    )


@query(
    "select_language",
    f"WITH {PROFILES}, {_detected('doc_grams', 'doc_id')} "
    "SELECT 'doc://' || doc_id AS url, source AS title FROM documents JOIN detected USING (doc_id) "
    "WHERE language = 'en' AND score >= 0.95",
)
def english(spark, sf):
    return select_language(articles(spark, sf), profiles(spark, sf), LANGUAGES).select("url", "title")


INGESTED = f"""WITH {PROFILES}, {EXTRACTED},
pages_ok AS (SELECT * FROM extracted WHERE content IS NOT NULL),
page_copies AS (SELECT *, count(*) OVER (PARTITION BY sha256(content)) AS copies FROM pages_ok),
{_grams('page_grams', 'pages_ok', 'url', 'content')}, {_detected('page_grams', 'url')}
SELECT url, title, content, 'article' AS status FROM page_copies JOIN detected USING (url)
WHERE copies = 1 AND language = 'en' AND score >= 0.95
UNION ALL SELECT url, NULL, NULL, 'rejected' FROM page_copies WHERE copies > 1
UNION ALL SELECT url, NULL, NULL, 'rejected' FROM extracted WHERE content IS NULL"""


def _store(spark):
    paths = new_path(spark, "articles"), new_path(spark, "rejected")
    store.ensure_tables(spark, *paths)
    return paths


def _stored(spark, paths):
    stored = store.read_articles(spark, paths[0]).select("url", "title", "content", F.lit("article").alias("status"))
    none = F.lit(None).cast("string")
    rejected = store.read_rejected(spark, paths[1])
    return stored.unionByName(
        rejected.select("url", none.alias("title"), none.alias("content"), F.lit("rejected").alias("status"))
    )


@query("ingest", INGESTED)
def ingested(spark, sf):
    paths = _store(spark)
    # the second run finds every stored and rejected url known; other languages come again and are left out again
    learned = profiles(spark, sf)
    for _ in range(2):
        ingest(pages(spark, sf), *paths, learned, LANGUAGES, F.lit("2024-01-01 00:00:00"))
    return _stored(spark, paths)


@query("ingest_known_urls", INGESTED)
def ingested_with_index(spark, sf):
    paths = _store(spark)
    known = KnownUrls(spark, new_path(spark, "known"), 8)
    learned = profiles(spark, sf)
    for _ in range(2):
        ingest(pages(spark, sf), *paths, learned, LANGUAGES, F.lit("2024-01-01 00:00:00"), known)
    return _stored(spark, paths)


@query(
    "ingest_sites",
    f"""{INGESTED.replace('WITH ', f'WITH {LINKS}, ', 1)}
    UNION ALL SELECT site, NULL, all_urls || ' ' || 0 || ' ' || all_urls, 'site'
    FROM (SELECT site, count(*) AS all_urls FROM candidates GROUP BY site)""",
)
def ingested_sites(spark, sf):
    """From a source list to articles, rejected urls and fetch statistics per site."""
    paths, sources = _store(spark), new_path(spark, "sources")
    table(spark, sf, "pages").select(site_of(F.col("url")).alias("url")).distinct().write.csv(sources, header=True)
    stats = ingest_sites(
        store.read_sources(spark, sources), pages(spark, sf), *paths, profiles(spark, sf), LANGUAGES, F.lit("2024-01-01 00:00:00")
    )
    counted = F.concat_ws(" ", "all_urls", "ignored", "new_urls")
    none = F.lit(None).cast("string")
    sites = stats.select(F.col("site").alias("url"), none.alias("title"), counted.alias("content"), F.lit("site").alias("status"))
    return _stored(spark, paths).unionByName(sites)


@query("ingest_stream", INGESTED)
def ingested_stream(spark, sf):
    paths = _store(spark)
    stream = ingest_stream(
        spark, f"{sf}/pages*.parquet", *paths, profiles(spark, sf), LANGUAGES, new_path(spark, "offsets"),
        F.lit("2024-01-01 00:00:00"),
    )
    stream.awaitTermination()
    return _stored(spark, paths)
