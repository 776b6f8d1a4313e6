"""Merging of labels: groups from close pairs, thresholds by distance and by size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .distances import close_pairs, nearest_big_cluster, pairwise_distances
from .groups import centroids, dense_codes, largest_gap_threshold, quantile_bins, relabel
from .label_sets import closure_mapping, overlap_mapping
from .placement import settle

Labels = frozenset


def _drop_contained(sets: list[Labels]) -> list[Labels]:
    """From the largest size down, take contained smaller sets away from the sets of that size.

    Sizes are those present at the start, the smallest excepted.  When some set of the current
    size contains a smaller one, the smaller one is removed from every set of that size.
    """
    sizes = sorted({len(s) for s in sets}, reverse=True)
    for rank, size in enumerate(sizes[:-1]):
        of_size = [s for s in sets if len(s) == size]
        smaller = [s for s in sets if len(s) > 1 and len(s) in sizes[rank + 1 :]]
        contained = Labels().union(*(s for s in smaller if any(s <= big for big in of_size)))
        sets = [s - contained if len(s) == size else s for s in sets]
    return [s for s in dict.fromkeys(sets) if len(s) > 1]


def overlapping_groups(pairs: Iterable[tuple[int, int]]) -> list[Labels]:
    """Disjoint groups of labels from neighbour pairs (label, neighbour), for the few labels of a topic node;
    ``label_sets.overlap_mapping`` does the same as joins.

    Not a transitive closure: each remaining set grows once over the sets after it, and a
    group that shares a label with an earlier group is discarded.
    """
    neighbours: dict[int, set[int]] = {}
    for a, b in sorted(pairs):
        neighbours.setdefault(a, {a}).add(b)
    sets = sorted(dict.fromkeys(Labels(s) for s in neighbours.values()), key=len, reverse=True)
    sets = _drop_contained(sets)
    groups: list[Labels] = []
    for i, grown in enumerate(sets):
        for other in sets[i + 1 :]:
            if grown & other:
                grown |= other
        if all(grown.isdisjoint(g) for g in groups):
            groups.append(grown)
    return groups


def merge_labels(labels: DataFrame, pairs: DataFrame, rule: str = "overlap") -> DataFrame:
    """(label, new_label): labels grouped by close pairs, smallest label each, made dense from 0.

    ``labels`` holds every label in column ``label``; ``pairs`` holds (a, b).
    """
    mapping = overlap_mapping(pairs) if rule == "overlap" else closure_mapping(pairs)
    merged = labels.select("label").distinct().join(mapping, "label", "left")
    merged = merged.withColumn("target", F.coalesce("target", "label"))
    codes = dense_codes(merged, "target")
    return merged.join(codes, "target").select("label", F.col("code").alias("new_label"))


def _threshold(values: DataFrame, column: str, q: int) -> float | None:
    row = largest_gap_threshold(quantile_bins(values, column, q)).first()
    return None if row is None else row.threshold


def distance_merge_mapping(
    df: DataFrame, label: str = "label", features: str = "features", metric: str = "cosine",
    q: int = 20, rule: str = "overlap",
) -> DataFrame:
    """(label, new_label) from merging labels with close centroids."""
    labels = df.select(F.col(label).alias("label"), F.col(features).alias("features"))
    centers = settle(centroids(labels))
    distances = settle(pairwise_distances(centers, metric).where("dist IS NOT NULL"))
    threshold = _threshold(distances, "dist", q)
    pairs = distances.where(F.lit(False)) if threshold is None else close_pairs(distances, threshold)
    return merge_labels(centers, pairs, rule)


def size_merge_mapping(
    df: DataFrame, label: str = "label", features: str = "features", q: int = 20, rule: str = "overlap"
) -> DataFrame:
    """(label, new_label) from merging each small label into its closest big one."""
    labels = df.select(F.col(label).alias("label"), F.col(features).alias("features"))
    centers = settle(centroids(labels))
    threshold = _threshold(centers, "size", q)
    distances = pairwise_distances(centers).where("dist IS NOT NULL")
    if threshold is None:
        pairs = distances.where(F.lit(False))
    else:
        pairs = nearest_big_cluster(centers, distances, threshold)
    return merge_labels(centers, pairs, rule)


def merge_by_distance(df: DataFrame, label: str = "label", **options) -> DataFrame:
    return relabel(df, distance_merge_mapping(df, label, **options), label, _spread(df, label))


def merge_by_size(df: DataFrame, label: str = "label", **options) -> DataFrame:
    return relabel(df, size_merge_mapping(df, label, **options), label, _spread(df, label))


def _spread(df: DataFrame, label: str) -> list[str]:
    """Columns that tell rows apart: atomic ones, vectors left out."""
    atomic = [f.name for f in df.schema if f.name != label and isinstance(f.dataType, T.AtomicType)]
    return atomic or [label]
