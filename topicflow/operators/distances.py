"""Distances between label centroids and nearest-neighbour operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .placement import top_n_per_group

CENTROID_ROWS = 10_000


def pairwise_distances(centroids: DataFrame, metric: str = "cosine", label: str = "label") -> DataFrame:
    """(a, b, dist) for every ordered pair of different labels.

    The products are built like a matrix product, by an equi-join on the dimension.  A zero
    centroid has no cosine distance and yields null.
    """
    long = centroids.select(label, F.posexplode("centroid").alias("dim", "x"))
    a = long.select(F.col(label).alias("a"), "dim", "x")
    b = long.select(F.col(label).alias("b"), "dim", F.col("x").alias("y"))
    pairs = a.join(b, "dim").where("a <> b").groupBy("a", "b")
    if metric == "euclidean":
        return pairs.agg(F.sqrt(F.sum(F.expr("(x - y) * (x - y)"))).alias("dist"))
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric}")
    # squared norms are summed per pair too, so that both directions give the same number
    cosine = F.try_divide(F.sum(F.expr("x * y")), F.sqrt(F.sum(F.expr("x * x"))) * F.sqrt(F.sum(F.expr("y * y"))))
    return pairs.agg((F.lit(1.0) - cosine).alias("dist"))


def close_pairs(distances: DataFrame, threshold: float) -> DataFrame:
    return distances.where(F.col("dist") <= threshold)


def nearest_topic(distances: DataFrame) -> DataFrame:
    """(a, b, dist, name): the closest other label of each label; ties go to the smaller label."""
    nearest = distances.groupBy("a").agg(F.min(F.struct("dist", "b")).alias("m"))
    return nearest.select(
        "a", "m.b", "m.dist", F.concat_ws(" | ", F.col("a").cast("string"), F.col("m.b").cast("string")).alias("name")
    )


def nearest_big_cluster(
    sizes: DataFrame, distances: DataFrame, threshold: float, label: str = "label"
) -> DataFrame:
    """(a, b): each label of size <= threshold with its closest label of a larger size."""
    small = sizes.where(F.col("size") <= threshold).select(F.col(label).alias("a"))
    big = sizes.where(F.col("size") > threshold).select(F.col(label).alias("b"))
    candidates = distances.join(small, "a").join(big, "b")
    return candidates.groupBy("a").agg(F.min(F.struct("dist", "b"))["b"].alias("b"))


def _lowest(ranks: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` lowest numbers of each column, in order, the earlier row on a tie; NaN comes last.

    A column is split at its k-th number, and only what is not above that is sorted.
    """
    ranks = np.where(np.isnan(ranks), np.inf, ranks)
    n = min(k, len(ranks))
    bounds = np.partition(ranks, n - 1, axis=0)[n - 1]
    best = np.empty((n, ranks.shape[1]), np.int64)
    for column, bound in enumerate(bounds):
        near = np.flatnonzero(ranks[:, column] <= bound)
        best[:, column] = near[np.argsort(ranks[near, column], kind="stable")[:n]]
    return best


def top_words(centroids: DataFrame, word_vectors: DataFrame, k: int = 5, label: str = "label") -> DataFrame:
    """(label, rn, word, similarity): the k words with the highest cosine to each centroid.

    The centroids travel to the tasks, at most ``CENTROID_ROWS`` of them at a time; every batch
    of words gives its k best per centroid, so what is shuffled does not grow with the product
    of the two.
    """
    slices = -(-centroids.count() // CENTROID_ROWS)
    if slices > 1:
        part = F.pmod(F.xxhash64(label), F.lit(2 * slices))
        parts = [top_words(centroids.where(part == i), word_vectors, k, label) for i in range(2 * slices)]
        return reduce(DataFrame.unionByName, parts)
    table = centroids.select(label, "centroid").toArrow()
    labels = table.column(label).to_pylist()
    matrix = np.array(table.column("centroid").to_pylist(), dtype=float).reshape(len(labels), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    def best_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not labels:
                continue
            words = np.array(batch.column(0).to_pylist(), dtype=object)
            by_word = np.argsort(words, kind="stable")
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(words), -1)
            vectors, words = vectors[by_word], words[by_word]
            lengths = np.linalg.norm(vectors, axis=1)
            cosines = (vectors @ matrix.T) / np.where(lengths > 0, lengths, 1.0)[:, None]
            # highest cosine first, then the word, as in the final ranking
            best = _lowest(-np.round(cosines, 9), k)
            codes = np.tile(np.arange(len(labels), dtype=np.int32), len(best))
            yield pa.record_batch(
                [
                    pa.array(codes),
                    pa.array(words[best.ravel()], pa.string()),
                    pa.array(np.take_along_axis(cosines, best, axis=0).ravel()),
                ],
                ["code", "word", "similarity"],
            )

    scored = word_vectors.select("word", "vector").mapInArrow(
        best_of_batch, "code int, word string, similarity double"
    )
    ranked = top_n_per_group(
        scored.withColumn("_order", -F.round("similarity", 9)), ["code"], [F.col("_order"), F.col("word")], k, ["word"]
    )
    codes = centroids.sparkSession.createDataFrame(
        [(i, value) for i, value in enumerate(labels)],
        T.StructType([T.StructField("code", T.IntegerType()), centroids.schema[label]]),
    )
    return ranked.join(F.broadcast(codes), "code").select(label, "rn", "word", "similarity")
