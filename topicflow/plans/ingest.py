"""Ingest: stored pages → new articles and rejected urls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import drop_all_duplicates, drop_failed, fetch_stats, new_urls
from ..operators.lang import select_language
from ..session import materialize
from ..sources.known_urls import KnownUrls
from ..sources.pages import discover_urls, extract_articles, site_of
from ..sources.store import append_articles, append_rejected, read_articles, read_rejected, urls_to_ignore


def clean_batch(
    pages: DataFrame,
    ignore: DataFrame | None,
    profiles: DataFrame,
    languages: Sequence[str],
    parse_datetime: Column,
    lang: str = "en",
    min_score: float = 0.95,
    reject_language: bool = False,
    scope: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new articles in the language, rejected urls) of one run.

    Unknown pages (all, if there is no ignore list) are parsed, failed ones rejected, all copies of repeated texts rejected,
    other languages left out (and rejected on request).  With ``scope``, the stored articles,
    texts that the store already holds are rejected, too.
    """
    unknown = pages if ignore is None else new_urls(pages, ignore)
    parsed = materialize(extract_articles(unknown, parse_datetime), name="parsed")
    articles, failed = drop_failed(parsed)
    unique, repeated = drop_all_duplicates(articles, scope=scope)
    selected = materialize(select_language(unique, profiles, languages, lang, min_score), name="selected")
    rejected = failed.unionByName(repeated)
    if reject_language:
        rejected = rejected.unionByName(unique.select("url").join(selected, "url", "left_anti"))
    return selected, rejected


def ingest(
    pages: DataFrame,
    articles_path: str,
    rejected_path: str,
    profiles: DataFrame,
    languages: Sequence[str],
    parse_datetime: Column | None = None,
    known: KnownUrls | None = None,
    **options,
) -> None:
    """Append one run to the store.

    Urls already stored or rejected are skipped, so repeating a run after a failure adds
    only what is missing.  With ``known``, an index of them, the store is not read for that; the index
    gets the urls of the run at its end.  After a failed run, or to begin with, add
    ``urls_to_ignore`` of the store to it.
    """
    spark = pages.sparkSession
    if known is None:
        ignore = urls_to_ignore(read_articles(spark, articles_path), read_rejected(spark, rejected_path))
    else:
        pages, ignore = known.unknown(pages), None
    now = F.lit(spark.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')").first()[0])
    selected, rejected = clean_batch(
        pages, ignore, profiles, languages, now if parse_datetime is None else parse_datetime, **options
    )
    rejected = materialize(rejected, name="rejected")
    append_articles(selected, articles_path)
    append_rejected(rejected, rejected_path)
    if known is not None:
        known.add(urls_to_ignore(selected, rejected))


def ingest_sites(
    sources: DataFrame,
    pages: DataFrame,
    articles_path: str,
    rejected_path: str,
    profiles: DataFrame,
    languages: Sequence[str],
    parse_datetime: Column | None = None,
    **options,
) -> DataFrame:
    """One run over the sites of a source list (url): the links on their stored pages and the pages
    themselves are the candidates; those not known yet are ingested.

    Returns (site, all_urls, ignored, new_urls), as counted before the run.
    """
    spark = pages.sparkSession
    sites = sources.select(site_of(F.col("url")).alias("_site")).distinct()
    own = pages.join(sites, site_of(F.col("url")) == F.col("_site"), "left_semi")
    candidates = discover_urls(own).unionByName(own.select(site_of(F.col("url")).alias("site"), "url"))
    candidates = materialize(candidates, name="candidates")
    ignore = urls_to_ignore(read_articles(spark, articles_path), read_rejected(spark, rejected_path))
    stats = materialize(fetch_stats(candidates, ignore), name="stats")
    wanted = new_urls(candidates, ignore).select("url").distinct()
    found = pages.join(wanted, "url", "left_semi")
    ingest(found, articles_path, rejected_path, profiles, languages, parse_datetime, **options)
    return stats
