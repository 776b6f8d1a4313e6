"""Ingest as a stream: each micro-batch of stored pages is one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest

PAGES = "page_id BIGINT, url STRING, html STRING"


def ingest_stream(
    spark: SparkSession,
    path: str,
    articles_path: str,
    rejected_path: str,
    profiles: DataFrame,
    languages: Sequence[str],
    checkpoint: str,
    parse_datetime: Column | None = None,
    **options,
) -> StreamingQuery:
    """Ingest every page file that has arrived, then stop.

    Dropping all copies of a text needs all texts of the run, which a stateful operator cannot
    express; hence ``foreachBatch``, and no limit on the files of a batch: whatever has arrived
    is one run, however many files it has.  A batch that is replayed after a
    failure skips the urls it has already stored.
    """

    def one_run(batch: DataFrame, _: int) -> None:
        ingest(batch.select("url", "html"), articles_path, rejected_path, profiles, languages, parse_datetime, **options)

    return (
        spark.readStream.schema(PAGES)
        .parquet(path)
        .writeStream.foreachBatch(one_run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
