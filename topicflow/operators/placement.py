"""How rows are placed on tasks: skewed joins, bounded lookups, ranks and top-n per group.

No operator here puts all rows of one key on one task.  Salts come from a hash of row
content, never from ``rand``, so a recomputed task places its rows as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

HOT_SHARE = 1000
HOT_ROWS = 10_000
SALTS = 64
LOOKUP_ROWS = 10_000


def hot_keys(
    df: DataFrame,
    key: str,
    share: int = HOT_SHARE,
    min_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Keys that hold more than 1/``share`` of all rows, and at least ``min_rows``.

    Fewer than ``share`` keys can do so, whatever the data: the result is small enough to
    broadcast by construction.  ``counts`` (key, rows) is used when already known; it may
    leave out rare keys, as the share is then one of the rows it counts.
    """
    if counts is None:
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.where((F.col("rows") >= min_rows) & (F.col("rows") * share > total)).select(key)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join on ``key`` where ``left`` may hold a large part of its rows under few keys.

    Rows of hot keys are spread over ``salts`` tasks by a hash of the ``spread`` columns and
    the matching ``right`` rows are repeated that often; all other keys keep one salt.
    ``right`` is expected to have few rows per key.  Null keys match nothing and are spread.
    """
    if hot is None:
        hot = hot_keys(left, key)
    hot = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    spread_salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = (
        left.join(hot, key, "left")
        .withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), spread_salt).otherwise(0))
        .drop("_hot")
    )
    repeated = (
        right.join(hot, key, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot")
    )
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def bounded(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame | None:
    """``df`` as a local table if it has at most ``max_rows`` rows, else None."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def settle(df: DataFrame, max_rows: int = 10 * LOOKUP_ROWS) -> DataFrame:
    """Compute ``df`` once: a local table when it is small, a stage table otherwise."""
    small = bounded(df, max_rows)
    return materialize(df) if small is None else small


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    key: str,
    spread: Sequence[str],
    how: str = "left",
    max_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """Join with a lookup table: broadcast when its size was checked, salted shuffle otherwise."""
    small = bounded(lookup, max_rows)
    if small is not None:
        return left.join(F.broadcast(small), key, how)
    return skew_join(left, lookup, key, spread, how)


def shuffle_hash(key: Column, seed: int | Column) -> Column:
    """Seeded order key: md5 of the row key followed by the seed."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat(key.cast("string"), seed))


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str]
) -> DataFrame:
    """The first ``n`` rows of each group, ranked in two steps so that no task sees a whole group.

    The last step ranks at most ``n * SALTS`` rows per group.  Adds ``rn`` (1-based).
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("rn", F.row_number().over(part))
        .where(F.col("rn") <= n)
        .withColumn("rn", F.row_number().over(whole))
        .where(F.col("rn") <= n)
        .drop("_salt")
    )


def group_buckets(df: DataFrame, group: Sequence[str], digits: int) -> DataFrame:
    """Rows per (group, leading digits of ``_hash``) with the rows before it and in all of the group.

    A group has at most 16**digits buckets, which bounds the window below.
    """
    running = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return (
        df.groupBy(*group, F.substring("_hash", 1, digits).alias("_bucket"))
        .agg(F.count("*").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0)))
        .withColumn("group_size", F.sum("_size").over(whole))
    )


def shuffled_rank(df: DataFrame, group: Sequence[str], key: str, seed: int = 45, digits: int = 3) -> DataFrame:
    """Adds ``rank`` (0-based, by seeded hash order) and ``group_size`` without one task per group.

    Hash order is uniform, so each (group, bucket) window holds about 1/16**digits of a group.
    """
    hashed = df.withColumn("_hash", shuffle_hash(F.col(key), seed))
    buckets = group_buckets(hashed, group, digits)
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", key)
    return (
        hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
        .withColumn("_inside", F.row_number().over(inside) - 1)
        .join(buckets, [*group, "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_inside"))
        .drop("_hash", "_bucket", "_inside", "_before", "_size")
    )
