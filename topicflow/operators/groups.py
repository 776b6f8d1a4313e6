"""Aggregates per topic label: centroids, sizes, quantile bins, dispersion, rollups, joined strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_array, as_vector, mean_vector
from .placement import lookup_join


def centroids(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """(label, centroid, size): mean vector per label, combined on the map side."""
    means = df.groupBy(label).agg(mean_vector(features).alias("m"), F.count("*").alias("size"))
    return means.select(label, as_array(F.col("m")).alias("centroid"), "size")


def cluster_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, size, relative): size and size relative to the largest."""
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max("size")).scalar()
    return sizes.withColumn("relative", F.col("size") / largest)


def _rounded_edge(x: Column, precision: Column) -> Column:
    """Below 1: that many significant digits, from 1 up: that many decimals; half to even."""
    leading = -F.floor(F.log10(F.abs(x))) - 1 + precision
    digits = F.when(F.abs(x) >= 1, precision).otherwise(leading)
    return F.when(x == 0, x).otherwise(F.rint(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))


def quantile_bins(df: DataFrame, col: str, q: int = 20) -> DataFrame:
    """(bin, left, right): quantile intervals with repeated edges dropped and edges rounded.

    The input is a table of labels or label pairs.  Rounding starts at 3 digits and takes
    more when edges would collide; the first left edge is lowered by one unit of the digits.
    """
    points = F.array(*(F.lit(i / q) for i in range(q + 1)))
    edges = df.agg(F.percentile(F.col(col).cast("double"), points).alias("e")).select(
        F.array_distinct("e").alias("e")
    )
    tried = edges.where("size(e) > 1").select("e", F.explode(F.sequence(F.lit(3), F.lit(19))).alias("p"))
    rounded = tried.select("p", F.transform("e", lambda x: _rounded_edge(x, F.col("p"))).alias("e"))
    collide = F.size(F.array_distinct("e")) < F.size("e")
    chosen = rounded.agg(F.min_by(F.struct("e", "p"), F.struct(collide, F.col("p"))).alias("c"))
    bins = F.expr(
        "transform(sequence(1, size(c.e) - 1), i -> struct(i - 1 AS bin, "
        "c.e[i - 1] - IF(i = 1, pow(10D, -c.p), 0D) AS left, c.e[i] AS right))"
    )
    return chosen.where("c IS NOT NULL").select(F.inline(bins))


def largest_gap_threshold(bins: DataFrame) -> DataFrame:
    """(ratio, threshold): right edge of the bin, the last one excepted, where right / |left| is largest.

    The first such bin wins.  No row when there are fewer than two bins.
    """
    last = bins.agg(F.max("bin")).scalar()
    ratio = F.when(F.col("left") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(F.col("right"), F.abs(F.col("left")))
    )
    return (
        bins.where(F.col("bin") < last)
        .withColumn("ratio", ratio)
        .agg(
            F.max("ratio").alias("ratio"),
            F.max_by("right", F.struct("ratio", -F.col("bin"))).alias("threshold"),
        )
        .where("threshold IS NOT NULL")
    )


def calinski_harabasz(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """One row (clusters, score): between to within dispersion, from centred sums per label.

    Variances per label are accumulated around the running mean, and the distances of the
    centroids from their mean are taken as differences, so points far from the origin keep
    their digits.
    """
    groups = df.groupBy(label).agg(
        Summarizer.metrics("mean", "variance").summary(F.col(features)).alias("s"), F.count("*").alias("n")
    )
    spread = F.aggregate(as_array(F.col("s.variance")), F.lit(0.0), lambda a, x: a + x)
    groups = groups.select(
        as_array(F.col("s.mean")).alias("m"), "n", F.when(F.col("n") > 1, spread * (F.col("n") - 1)).otherwise(0.0).alias("within")
    )
    means = groups.agg(mean_vector(as_vector(F.col("m")), F.col("n").cast("double")).alias("m"))
    groups = groups.withColumn("center", means.select(as_array(F.col("m"))).scalar())
    offset = F.aggregate(F.zip_with("m", "center", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    total = groups.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("within").alias("within"), F.sum(F.col("n") * offset).alias("between")
    )
    score = F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return total.select(F.col("k").alias("clusters"), score.alias("score"))


def topic_path(levels: Sequence[str], level: int) -> Column:
    """Labels up to ``level`` joined by an underscore; null when the level is not reached."""
    reached = F.col(levels[level]).isNotNull()
    return F.when(reached, F.concat_ws("_", *(F.col(c).cast("string") for c in levels[: level + 1])))


def explode_paths(df: DataFrame, levels: Sequence[str], *keep: str) -> DataFrame:
    """One row per reached level: kept columns, level, topic_path."""
    paths = F.array(
        *(F.struct(F.lit(i).alias("level"), topic_path(levels, i).alias("topic_path")) for i in range(len(levels)))
    )
    return df.select(*keep, F.inline(paths)).where("topic_path IS NOT NULL")


def topic_rollup(df: DataFrame, levels: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates for every path prefix."""
    return explode_paths(df, levels, *df.columns).groupBy("level", "topic_path").agg(*aggregates)


def topic_counts(df: DataFrame, levels: Sequence[str], key: str = "url") -> DataFrame:
    """One row: articles and topics per level."""
    return df.agg(
        F.count(key).alias("articles"),
        *(F.count_distinct(topic_path(levels, i)).alias(f"topics_{i}") for i in range(len(levels))),
    )


def join_strings(df: DataFrame, key: Sequence[str], order: str, text: str, sep: str) -> DataFrame:
    """(key, joined): strings of a group in order.  For groups bounded by construction."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("s"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), sep).alias("joined"))


def dense_codes(values: DataFrame, column: str) -> DataFrame:
    """(column, code): distinct values numbered from 0 in order.  The window is over labels, not rows."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.withColumn("code", F.dense_rank().over(Window.orderBy(column)) - 1)


def dense_relabel(df: DataFrame, label: str = "label", spread: Sequence[str] | None = None) -> DataFrame:
    """Labels renumbered 0..k-1 in order."""
    spread = spread or [c for c in df.columns if c != label]
    joined = lookup_join(df, dense_codes(df, label), label, spread, "left")
    return joined.withColumn(label, F.col("code")).select(df.columns)


def encode_paths(df: DataFrame, path: str = "topic_path", spread: Sequence[str] | None = None) -> DataFrame:
    """Adds ``code``: position of the path in lexical order."""
    spread = spread or [c for c in df.columns if c != path]
    return lookup_join(df, dense_codes(df, path), path, spread, "left")


def relabel(df: DataFrame, mapping: DataFrame, label: str = "label", spread: Sequence[str] | None = None) -> DataFrame:
    """Replace labels by ``mapping`` (label, new_label); labels not in it stay."""
    spread = spread or [c for c in df.columns if c != label]
    joined = lookup_join(df, mapping.select(F.col("label").alias(label), "new_label"), label, spread, "left")
    return joined.withColumn(label, F.coalesce("new_label", label)).select(df.columns)


def as_topic_ints(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in levels})


def rows_of_topic(df: DataFrame, levels: Sequence[str], path: str) -> DataFrame:
    return df.where(topic_path(levels, path.count("_")) == path)


def default_topic_names(df: DataFrame, level: int, label: str) -> DataFrame:
    """(label, name): placeholder names ``level_label`` of the labels that occur."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    return labels.select(label, F.concat_ws("_", F.lit(level), label).alias("name"))
