"""Mixing sources to target weights.

Tokens are added up per source; each source's weight gives its share of all tokens, a source that
would be repeated more than ``max_repeats`` times stops there and its excess is shared again by
weight.  A source's repetition rate is its target over its size; a document is taken floor(rate)
times, and once more if a number drawn from the hash of its id is below the fraction.

Empty texts and nulls have size 0 and are repeated like their source; a null source is a source of
its own, after all others.  Rows with one id are drawn alike.  An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import column, fresh, hash_order, require

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """(source, size) to (source, source_size, target): one row per source, nulls included.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.  With caps
    ``max_repeats * size`` the targets are min(cap, level * weight) for the one level at which they
    add up to all tokens.  Sources reach their cap in the order of cap / weight.  With the first j
    of them capped, the others share what is left at some level; this level grows with j while the
    next source is still above its cap, and falls after that, so the largest one is the level.
    Windows run over one row per source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.lit(float(max_repeats)) * F.col("source_size"))
    )
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("_tokens") - F.col("_capped")) / (F.col("_weights") - F.col("_weighed"))
    levels = (
        ranked.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weighed", F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_tokens", F.sum("source_size").over(whole))
        .withColumn("_weights", F.sum("_weight").over(whole))
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(whole))
    )
    return levels.select(
        "source", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target")
    )


def mix_rates(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """All columns of ``docs`` and one struct ``mix`` (size, source_size, target, copies).

    The struct gets a longer name if ``docs`` has a column of that name; it is the last column.
    The table of sources has one row per source; Spark broadcasts it if it is small enough.
    """
    require(docs, [id_col, text_col, source_col])
    mark, key = fresh(docs, "mix", "mix_source")
    sized = docs.withColumn(mark, word_count(column(text_col)))
    sizes = docs.select(column(source_col).alias("source"), word_count(column(text_col)).alias("size"))
    targets = source_targets(sizes, weights, max_repeats).select(
        F.col("source").alias(key), F.struct("source_size", "target").alias(key + "_")
    )
    joined = sized.join(targets, F.col(key).eqNullSafe(column(source_col)))
    rate = F.when(F.col(f"{key}_.source_size") > 0, F.col(f"{key}_.target") / F.col(f"{key}_.source_size")).otherwise(0.0)
    extra = (hash_order(column(id_col), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(
        mark,
        F.struct(
            F.col(mark).alias("size"),
            F.col(f"{key}_.source_size").alias("source_size"),
            F.col(f"{key}_.target").alias("target"),
            (F.floor(rate) + extra).alias("copies"),
        ),
    ).select(*[column(c) for c in docs.columns], mark)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    rated = mix_rates(docs, **options)
    mark = rated.columns[-1]
    return rated.withColumn(mark, F.explode(F.array_repeat(F.lit(0), F.col(f"{mark}.copies").cast("int")))).drop(mark)
