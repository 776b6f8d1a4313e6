"""Known urls in buckets: a batch of candidates is moved to the list, never the list to the batch.

The list is a table of urls bucketed and sorted by url.  A join on the url reads each bucket where it
lies, so the cost of a run in shuffled rows is that of its candidates, however long the list has
grown.  New urls are placed by the same hash as the buckets, so that an append adds one file to each
bucket that gets any.

The files are the truth; the table entry of the session catalog is made anew from the folder when
a session opens it.  The folder is named after the number of buckets, as rows lie by it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# a bucket of 10^10 urls of 100 bytes is about a GB
BUCKETS = 1024


class KnownUrls:
    """An index of urls below ``path``; repeats and nulls are left out."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        location = f"{path.rstrip('/')}/buckets={buckets}"
        self.table = "known_urls_" + hashlib.md5(location.encode()).hexdigest()[:16]
        place = location.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (url STRING) USING parquet "
            f"CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def unknown(self, candidates: DataFrame) -> DataFrame:
        """The candidates whose url is not in the index, repeats among them kept; a null url is unknown.

        The candidates' distinct urls are moved, so a url that very many of them share does not
        meet the list in one task.
        """
        missing = candidates.select("url").distinct().join(self.read(), "url", "left_anti")
        missing = missing.withColumnRenamed("url", "_missing")
        return candidates.join(missing, F.col("url").eqNullSafe(F.col("_missing")), "left_semi")

    def add(self, urls: DataFrame) -> None:
        """Append the urls that are not in the index yet; a repeated call adds nothing."""
        wanted = urls.select("url").where(F.col("url").isNotNull()).distinct()
        new = materialize(wanted.join(self.read(), "url", "left_anti"), name="new_urls")
        new.repartition(self.buckets, "url").sortWithinPartitions("url").write.insertInto(self.table)
