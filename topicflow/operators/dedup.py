"""Failed articles, repeated texts, known urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..session import materialize
from .placement import skew_join


def fresh_since(df: DataFrame, since: str | Column) -> DataFrame:
    """Rows parsed at or after ``since``; a malformed time raises."""
    since = F.lit(since).cast("timestamp") if isinstance(since, str) else since
    return df.where(F.col("parse_datetime").cast("timestamp") >= since)


def flatten_batches(batches: DataFrame, column: str = "batch") -> DataFrame:
    """Arrays of article rows → rows; empty arrays vanish."""
    return batches.select(F.inline(column))


def drop_failed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles with content, urls without)."""
    return df.where("content IS NOT NULL"), df.where("content IS NULL").select("url")


def drop_all_duplicates(df: DataFrame, key: str = "url", scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose text occurs once, urls of all copies of repeated texts).

    Hashes are counted alone, combined before the shuffle, so copies never meet in one task.  Those
    that count more than one are staged as a narrow table; rows are dropped by a join with it, so texts
    are moved only where too many are repeated for a broadcast, and that join may split a hash under
    which very many rows fall.

    ``scope``, rows with a column ``content`` (such as the article store), widens the count
    from this run to all texts: what repeats a text of the scope is rejected, too.
    """
    narrow = df.select(key, content_hash(F.col("content")).alias("_h"))
    repeated = narrow.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    if scope is not None:
        stored = materialize(scope.select(content_hash(F.col("content")).alias("_h")).distinct(), name="stored")
        repeated = repeated.unionByName(stored).distinct()
    repeated = materialize(repeated, name="repeated")
    once = df.withColumn("_h", content_hash(F.col("content"))).join(repeated, "_h", "left_anti")
    return once.select(df.columns), narrow.join(repeated, "_h", "left_semi").select(key)


def distinct_texts(df: DataFrame, ordered: bool = True) -> DataFrame:
    distinct = df.select("content").distinct()
    return distinct.orderBy("content") if ordered else distinct


def distinct_of_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sorted distinct values of two text columns."""
    return df.select(F.explode(F.array(a, b)).alias("text")).distinct().orderBy("text")


def new_urls(candidates: DataFrame, ignore: DataFrame) -> DataFrame:
    """Candidates whose url is not known; repeats of a known url are left out together.

    Spark broadcasts the known urls when they are few, and may split a url that very many
    candidates share when not.
    """
    return candidates.join(ignore.select("url").distinct(), "url", "left_anti").select(candidates.columns)


def with_row_key(df: DataFrame, name: str = "row") -> DataFrame:
    """Adds a key made of url, text and parse time; rows that agree in all three are one row.

    The store does not enforce unique urls, so a url is no key of its rows.
    """
    parts = [F.coalesce(F.col(c), F.lit("\u0000")) for c in ("url", "content", "parse_datetime")]
    keyed = df.withColumn(name, F.sha2(F.concat_ws("\u0001", *parts), 256))
    return keyed.dropDuplicates([name])


def fetch_stats(candidates: DataFrame, ignore: DataFrame) -> DataFrame:
    """All, ignored and new candidates per site."""
    known = ignore.select("url").distinct().withColumn("known", F.lit(True))
    marked = skew_join(candidates.select("site", "url"), known, "url", ["site", "url"], "left")
    return marked.groupBy("site").agg(
        F.count("*").alias("all_urls"),
        F.count_if(F.col("known").isNotNull()).alias("ignored"),
        F.count_if(F.col("known").isNull()).alias("new_urls"),
    )
