"""Merkle manifest of a dataset, with nested-interval labels.

Each row is a leaf; the leaves of a group, in the order of their keys, are the leaves of its tree, and
the groups' roots, in the order of the groups, those of the tree above.  A node is labelled with the
interval ``[lo, hi)`` of leaf ranks that it covers and keeps the labels of its at most ``FANOUT`` parts.
At one level intervals are disjoint and aligned, so containment is an equality of level buckets plus a
check of the bounds: such joins hand each node what its ancestors know, from the top level down.  The
siblings of a node are the parts of its parent outside its own interval.

Ranks come from a range partitioning and counts per part, so no task sees a whole group; each level is
one aggregation, combined before the shuffle, of an eighth of the rows of the last, and is written as
a stage table.  Only the number of levels reaches the driver.

Null keys come first, a null group is a group, before all others.  Rows of one key are leaves of their
own, in the order of their digests; equal rows get different places and proofs.  A group of one row is its
own root; a dataset of one row has an empty proof.  An empty table gives an empty manifest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .frames import column, require

FANOUT = 8
NO_STEPS = "cast(array() as array<struct<left:string,right:string>>)"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as ``-`` if null, else its length in bytes, ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def ranked(leaves: DataFrame) -> DataFrame:
    """(grp, key, leaf, ...) with the interval [lo, hi) of each leaf and ``n``, the leaves of its group."""
    placed = materialize(
        leaves.repartitionByRange("grp", "key", "leaf")
        .sortWithinPartitions("grp", "key", "leaf")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id()),
        name="leaves",
    )
    parts = placed.groupBy("grp", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(  # a group has one row per written part at most
        "grp",
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("grp")).alias("n"),
    )
    lo = (F.col("_at") + F.col("_shift")).alias("lo")
    return placed.join(parts, ["grp", "_part"]).select(*leaves.columns, lo, (lo + 1).alias("hi"), "n")


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {FANOUT**level}L")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of ``level`` over those of the level below: grp, bucket, lo, hi, n, kids, digest."""
    kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))  # FANOUT of them at most
    found = nodes.groupBy("grp", _bucket(level).alias("bucket")).agg(kids.alias("kids"), F.max("n").alias("n"))
    return found.select(
        "grp",
        "bucket",
        F.get("kids", F.lit(0))["lo"].alias("lo"),
        F.element_at("kids", -1)["hi"].alias("hi"),
        "n",
        "kids",
        digest(F.array_join("kids.digest", "")).alias("digest"),
    )


@dataclass
class Tree:
    """``leaves`` (grp, key, leaf, lo, hi, n, ...) and ``levels``, the nodes of level 1, 2, ..."""

    leaves: DataFrame
    levels: list[DataFrame]

    @classmethod
    def grow(cls, leaves: DataFrame) -> Tree:
        own = materialize(ranked(leaves), name="ranked")
        most = own.agg(F.max("n")).first()[0] or 0
        levels: list[DataFrame] = []
        nodes = own.select("grp", "lo", "hi", "n", F.col("leaf").alias("digest"))
        while most > FANOUT ** len(levels):
            # a group with one node left is done
            nodes = nodes.where(F.col("n") > FANOUT ** len(levels))
            levels.append(materialize(_parents(nodes, len(levels) + 1), name="level"))
            nodes = levels[-1].select("grp", "lo", "hi", "n", "digest")
        return cls(own, levels)

    def roots(self) -> DataFrame:
        """(grp, digest): the root of each group."""
        found = self.leaves.where("n = 1").select("grp", F.col("leaf").alias("digest"))
        for i, level in enumerate(self.levels, 1):
            found = found.union(level.where(F.col("n") <= FANOUT**i).select("grp", "digest"))
        return found

    def nodes(self) -> DataFrame:
        """(grp, level, lo, hi, digest) of all nodes, leaves at level 0."""
        found = self.leaves.select("grp", F.lit(0).alias("level"), "lo", "hi", F.col("leaf").alias("digest"))
        for i, level in enumerate(self.levels, 1):
            found = found.union(level.select("grp", F.lit(i).alias("level"), "lo", "hi", "digest"))
        return found

    def attach(self, above: DataFrame) -> DataFrame:
        """The leaves with the root of their group, ``top``, and their ``steps``, from the leaf's level
        up to what ``above`` (grp, steps, root) knows of each group."""
        names = ["grp", "lo", "hi", "kids", "top", "steps", "root"]
        up = None
        for i in range(len(self.levels), 0, -1):
            level = self.levels[i - 1]
            tops = level.where(F.col("n") <= FANOUT**i).join(above, "grp").withColumn("top", F.col("digest")).select(names)
            if up is not None:
                inner = _contained(level.where(F.col("n") > FANOUT**i), up, i).select(names)
                tops = tops.union(inner)
            up = materialize(tops, name="attached")
        own = self.leaves.columns
        alone = self.leaves.where("n = 1").join(above, "grp").withColumn("top", F.col("leaf")).select(*own, "top", "steps", "root")
        if up is None:
            return alone
        return _contained(self.leaves.where("n > 1"), up, 0).select(*own, "top", "steps", "root").union(alone)


def _contained(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` with ``kids`` of their own or none, joined with the parent that covers them."""
    names = [c for c in nodes.columns if c != "n"]
    over = parents.select(
        F.col("grp").alias("_grp"),
        _bucket(level + 1).alias("_bucket"),
        F.col("lo").alias("_lo"),
        F.col("hi").alias("_hi"),
        F.col("kids").alias("_kids"),
        "top",
        F.col("steps").alias("_steps"),
        "root",
    )
    same = (F.col("grp") == F.col("_grp")) & (_bucket(level + 1) == F.col("_bucket"))
    joined = nodes.join(over, same & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
    left = F.filter("_kids", lambda k: k["hi"] <= F.col("lo"))
    right = F.filter("_kids", lambda k: k["lo"] >= F.col("hi"))
    text = lambda kids: F.array_join(F.transform(kids, lambda k: k["digest"]), "")
    step = F.array(F.struct(text(left).alias("left"), text(right).alias("right")))
    return joined.select(*names, "n", "top", F.concat(step, "_steps").alias("steps"), "root")


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda own, s: digest(s["left"], own, s["right"]))


@dataclass
class Manifest:
    """``rows``: the carried columns, leaf, lo, hi, subroot, root and steps, an array of the digests left
    and right of the row's path, from the leaf up.  ``nodes``: the labels of the groups' trees."""

    rows: DataFrame
    nodes: DataFrame

    def write(self, path: str) -> None:
        self.rows.write.parquet(f"{path}/rows")
        self.nodes.write.parquet(f"{path}/nodes")


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str], key_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None
) -> Manifest:
    """A leaf per row of ``docs`` from its ``fields``; ``carry`` names further columns to keep with it."""
    require(docs, [*fields, key_col, group_col])
    carried = carry or {}
    group = column(group_col).cast("string")
    leaves = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("grp"),
        column(key_col).alias("key"),
        leaf_digest([column(f) for f in fields]).alias("leaf"),
        F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carried.items()]).alias("carried"),
    )
    # the texts are read once; what is placed by range are digests
    tree = Tree.grow(materialize(leaves, name="digests"))
    top = Tree.grow(tree.roots().select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("digest").alias("leaf")))
    crown = top.roots().select("grp", F.expr(NO_STEPS).alias("steps"), F.col("digest").alias("root"))
    above = materialize(top.attach(crown).select(F.col("key").alias("grp"), "steps", "root"), name="groups")
    rows = tree.attach(above).select(
        F.col("key").alias(key_col),
        *[F.col(f"carried.`{n}`").alias(n) for n in carried],
        "leaf",
        "lo",
        "hi",
        F.col("top").alias("subroot"),
        "root",
        "steps",
    )
    return Manifest(rows, tree.nodes())
