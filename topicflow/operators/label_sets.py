"""Groups of labels from pairs of close labels, as joins on narrow rows.

Two rules.  The closure rule takes connected components.  The overlap rule takes each label's set of
neighbours, takes smaller sets that are contained in larger ones away from these, lets each set
that is left grow once over the sets after it, and discards a group that meets an earlier one.

A set is rows (rank, item), the rank being its place in the order of sets.  No set, group or list of
sets is ever one value or in one task; each round is written as a stage table.  The driver sees the
distinct sizes of sets and whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .groups import dense_codes


def closure_mapping(pairs: DataFrame) -> DataFrame:
    """(label, target): smallest label reachable over pairs, by repeated minimum over neighbours.

    Each round also jumps to the target of the target, so few rounds are needed; every round
    is written as a stage table.
    """
    edges = materialize(
        pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        name="edges",
    )
    targets = edges.select(F.col("a").alias("label")).distinct().withColumn("target", F.col("label"))
    while True:
        near = (
            edges.join(targets.withColumnRenamed("label", "b"), "b")
            .groupBy(F.col("a").alias("label"))
            .agg(F.min("target").alias("near"))
        )
        stepped = targets.join(near, "label").select("label", "target", F.least("target", "near").alias("next"))
        jump = stepped.select(F.col("label").alias("next"), F.col("next").alias("jumped"))
        moved = materialize(
            stepped.join(jump, "next").select("label", F.col("target").alias("old"), F.col("jumped").alias("target")),
            name="targets",
        )
        targets = moved.select("label", "target")
        if moved.where("old <> target").isEmpty():
            return targets


def _sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("rank").agg(F.count("*").alias("size"))


def _first_of_equal(sets: DataFrame) -> DataFrame:
    """One of the sets with the same items, the one with the lowest rank; equality by 128 bits and the size."""
    marks = [F.bit_xor(F.xxhash64("item", F.lit(seed))).alias(f"mark{seed}") for seed in (1, 2)]
    marked = sets.groupBy("rank").agg(F.count("*").alias("size"), *marks)
    return sets.join(marked.groupBy("size", "mark1", "mark2").agg(F.min("rank").alias("rank")).select("rank"), "rank")


def _contained_items(small: DataFrame, big: DataFrame) -> DataFrame:
    """(item) of the small sets that some big set contains.

    A big set that contains a small one has its rarest item; only these pairs are looked at.
    """
    frequency = big.groupBy("item").agg(F.count("*").alias("n"))
    counted = small.join(frequency, "item", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("rank").agg(F.min(F.struct("n", "item")).alias("r"), F.count("*").alias("size"))
    rarest = rarest.where("r.n > 0").select(F.col("rank").alias("small"), "size", F.col("r.item").alias("item"))
    candidates = rarest.join(big.withColumnRenamed("rank", "big"), "item").select("small", "size", "big")
    common = (
        candidates.join(small.withColumnRenamed("rank", "small"), "small")
        .join(big.withColumnRenamed("rank", "big"), ["big", "item"])
        .groupBy("small", "big", "size")
        .agg(F.count("*").alias("common"))
    )
    contained = common.where("common = size").select(F.col("small").alias("rank")).distinct()
    return small.join(contained, "rank", "left_semi").select("item").distinct()


def _without_contained(sets: DataFrame) -> DataFrame:
    """From the largest size down, contained smaller sets are taken away from all sets of that size.

    The sizes are those present at the start, the smallest excepted; a set that shrank takes part
    again at its new size if that is one of them.
    """
    sizes = sorted((r.size for r in _sizes(sets).select("size").distinct().collect()), reverse=True)
    known = sets.sparkSession.createDataFrame([(s,) for s in sizes], "size long")
    for size in sizes[:-1]:
        sized = sets.join(_sizes(sets), "rank")
        big = sized.where(F.col("size") == size).select("rank", "item")
        small = sized.where((F.col("size") > 1) & (F.col("size") < size)).join(F.broadcast(known), "size", "left_semi")
        gone = materialize(_contained_items(small.select("rank", "item"), big), name="contained")
        if not gone.isEmpty():
            lost = big.join(gone, "item", "left_semi")
            sets = materialize(sets.join(lost, ["rank", "item"], "left_anti"), name="sets")
    return sets


def _passed_on(start: DataFrame, sets: DataFrame, best, further: Column) -> DataFrame:
    """(rank): ``start`` and all sets that share an item with one of them and lie ``further`` than it, repeatedly."""
    found = materialize(start.select("rank").distinct(), name="found")
    known = found.count()
    while True:
        edge = sets.join(found, "rank").groupBy("item").agg(best("rank").alias("edge"))
        reached = sets.join(edge, "item").where(further).select("rank")
        found = materialize(found.union(reached).distinct(), name="found")
        known, last = found.count(), known
        if known == last:
            return found


def overlap_mapping(pairs: DataFrame) -> DataFrame:
    """(label, target) of the labels in a group of the overlap rule, from neighbour pairs (a, b).

    Pairs are read in one direction: a's set holds b.  Nulls are left out and repeated pairs count
    once; no pairs give no rows.

    A set grows over the later sets that it meets, and then over those that these meet: it takes up
    exactly the sets that are reached over sets of rising rank.  The first set of a connected part
    is always a group; every set from which rising ranks lead to one of its labels meets it and is
    discarded.  What is left is dealt with alike, all connected parts in the same round.
    """
    label = pairs.schema["a"].dataType
    pairs = pairs.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    own = pairs.union(pairs.select("a", F.col("a").alias("b"))).distinct()
    sets = materialize(_first_of_equal(own.select(F.col("a").alias("rank"), F.col("b").alias("item"))), name="sets")
    order = _sizes(sets).withColumn("order", F.struct((-F.col("size")).alias("s"), "rank"))
    ranks = order.select("rank", "order").join(dense_codes(order, "order"), "order").select("rank", "code")
    sets = sets.join(ranks, "rank").select(F.col("code").cast("long").alias("rank"), "item")
    sets = _without_contained(materialize(sets, name="sets"))
    sets = _first_of_equal(sets.join(_sizes(sets).where("size > 1").select("rank"), "rank"))
    left = materialize(sets, name="sets")
    mapping = None
    while True:
        first = left.groupBy("item").agg(F.min("rank").alias("first"))
        links = left.join(first, "item").select(F.col("rank").alias("a"), F.col("first").alias("b"))
        parts = closure_mapping(links).withColumnRenamed("label", "rank")
        grown = _passed_on(parts.where("rank = target"), left, F.min, F.col("rank") > F.col("edge"))
        items = left.join(grown, "rank").join(parts, "rank").select("target", "item").distinct()
        least = items.groupBy("target").agg(F.min("item").alias("least"))
        groups = materialize(
            items.join(least, "target").select(F.col("item").alias("label"), F.col("least").cast(label).alias("target")),
            name="groups",
        )
        mapping = groups if mapping is None else mapping.union(groups)
        meeting = left.join(groups.select(F.col("label").alias("item")), "item", "left_semi")
        discarded = _passed_on(meeting, left, F.max, F.col("rank") < F.col("edge"))
        left = materialize(left.join(discarded, "rank", "left_anti"), name="sets")
        if left.isEmpty():
            return mapping
