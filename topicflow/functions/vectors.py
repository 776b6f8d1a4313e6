"""Vector expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(col: Column) -> Column:
    return col.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    norm = F.greatest(F.sqrt(squared_norm(a)), F.lit(1e-12))
    return F.transform(a, lambda x: x / norm)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null when a vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def topk_renormalize(probabilities: Column, k: int) -> Column:
    """Keep the ``k`` largest entries (ties: lower index first), zero the others, divide by their sum."""
    ranked = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    kept = F.transform(F.slice(ranked, 1, k), lambda s: s["i"])
    total = F.aggregate(F.slice(ranked, 1, k), F.lit(0.0), lambda s, x: s - x["p"])
    return F.transform(
        probabilities, lambda p, i: F.when(F.array_contains(kept, i), p / total).otherwise(F.lit(0.0))
    )


def mean_vector(col: Column | str, weight: Column | None = None) -> Column:
    """Aggregate: (weighted) mean of a vector column, combined on the map side."""
    col = F.col(col) if isinstance(col, str) else col
    return Summarizer.mean(col, weight) if weight is not None else Summarizer.mean(col)


def as_vector(col: Column) -> Column:
    return array_to_vector(doubles(col))


def as_array(col: Column) -> Column:
    return vector_to_array(col)
