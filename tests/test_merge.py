import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicflow.functions.vectors import as_vector, topk_renormalize
from topicflow.operators import distances as D
from topicflow.operators import groups as G
from topicflow.operators import label_sets as L
from topicflow.operators import merge as M


def both_ways(pairs):
    return [*pairs, *((b, a) for a, b in pairs)]


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([], []),
        ([(1, 2)], [{1, 2}]),
        ([(1, 2), (2, 3), (3, 4)], [{1, 2}, {3, 4}]),
        ([(1, 2), (2, 3), (1, 3)], [{1, 2, 3}]),
        ([(1, 2), (5, 6)], [{1, 2}, {5, 6}]),
    ],
)
def test_overlap_groups(pairs, expected):
    groups = M.overlapping_groups(both_ways(pairs))
    assert sorted(map(sorted, groups)) == sorted(map(sorted, expected))


def test_stars_give_one_group_per_center():
    assert sorted(map(sorted, M.overlapping_groups([(1, 5), (2, 5), (3, 6)]))) == [[1, 2, 5], [3, 6]]


def test_merge_rules_on_a_chain(spark):
    labels = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "label int")
    pairs = spark.createDataFrame(both_ways([(1, 2), (2, 3), (3, 4)]), "a int, b int")
    mapped = lambda rule: {r.label: r.new_label for r in M.merge_labels(labels, pairs, rule).collect()}
    assert mapped("overlap") == {1: 0, 2: 0, 3: 1, 4: 1, 9: 2}
    assert mapped("closure") == {1: 0, 2: 0, 3: 0, 4: 0, 9: 1}


def test_closure_of_a_long_chain(spark):
    n = 40
    labels = spark.createDataFrame([(i,) for i in range(n)], "label int")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a int, b int")
    assert {r.new_label for r in M.merge_labels(labels, pairs, "closure").collect()} == {0}


def moves(spark, pairs):
    frame = spark.createDataFrame(pairs, "a int, b int")
    return sorted(tuple(r) for r in L.overlap_mapping(frame).collect())


def slow_moves(pairs):
    return sorted((m, min(g)) for g in M.overlapping_groups(pairs) for m in g)


def random_pairs(labels, n, seed):
    random = np.random.RandomState(seed)
    return [(int(a), int(b)) for a, b in random.randint(0, labels, (n, 2)) if a != b]


@pytest.mark.parametrize(
    "pairs",
    [
        [],
        [(1, 1)],
        both_ways([(1, 2), (2, 3), (3, 4)]),
        # a shrunk set of five, contained in another set of three
        [(1, 2), (1, 3), (1, 4), (1, 5), (3, 4), (3, 5), (8, 1), (8, 2), (1, 2)],
        # one label close to all others
        both_ways([(0, i) for i in range(1, 30)]),
        both_ways(random_pairs(14, 14, 1)),
        random_pairs(12, 30, 2),
    ],
)
def test_overlap_on_joins_equals_the_slow_rule(spark, pairs):
    assert moves(spark, pairs) == slow_moves(pairs)


def test_overlap_on_joins_of_2000_labels(spark):
    pairs = both_ways(random_pairs(2000, 1200, 3))
    assert moves(spark, pairs) == slow_moves(pairs)


def test_overlap_leaves_out_null_labels(spark):
    assert moves(spark, [(1, 2), (None, 2), (2, None), (1, 2), (2, 1)]) == [(1, 1), (2, 1)]


@pytest.mark.parametrize(
    "values",
    [
        [0.0012345, 0.002, 0.4, 0.5, 0.9],
        list(np.random.RandomState(0).rand(90)),
        list(np.random.RandomState(1).randint(1, 400, 20)),
        [44.0, 46.0, 47.0, 50.0, 53.0, 53.0, 59.0, 120.5],
        [0.123456, 0.1234561, 0.1234562],
        [7.0, 7.0, 7.0],
    ],
)
def test_quantile_bins_equal_qcut(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ours = [(r.left, r.right) for r in G.quantile_bins(df, "v").orderBy("bin").collect()]
    cut = pd.qcut(pd.Series(values, dtype=float), 20, duplicates="drop")
    expected = [(i.left, i.right) for i in sorted(cut.cat.categories)]
    assert np.allclose(ours, expected, atol=1e-12) if expected else ours == []


def test_largest_gap(spark):
    bins = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 8.0), (2, 2.0, 8.0), (3, 8.0, 99.0)], "bin int, left double, right double")
    assert G.largest_gap_threshold(bins).collect() == [(4.0, 8.0)]
    assert G.largest_gap_threshold(bins.where("bin = 3")).isEmpty()
    zero = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 9.0)], "bin int, left double, right double")
    assert G.largest_gap_threshold(zero).first().threshold == 1.0


def points(spark, groups):
    rows = [(i * 100 + j, i, [float(x) + 0.001 * j for x in center]) for i, (center, n) in enumerate(groups) for j in range(n)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>").select(
        "id", "label", as_vector(F.col("v")).alias("features")
    )


def test_equal_distances_do_not_merge(spark):
    df = points(spark, [((1, 0), 3), ((0, 1), 3)])
    assert M.merge_by_distance(df).select("label").distinct().count() == 2
    one = df.where("label = 0")
    assert M.merge_by_distance(one).select("label").distinct().count() == 1


def test_close_clusters_merge_and_labels_are_dense(spark):
    df = points(spark, [((1, 0, 0), 3), ((1, 0.01, 0), 3), ((0, 1, 0), 3), ((0, 0, 1), 3)])
    merged = {r.label: r.new_label for r in M.distance_merge_mapping(df).collect()}
    assert merged[0] == merged[1] and sorted(set(merged.values())) == list(range(len(set(merged.values()))))


def test_small_cluster_goes_to_its_nearest_big_one(spark):
    df = points(spark, [((1, 0, 0), 2), ((1, 0.1, 0), 40), ((0, 1, 0), 41), ((0, 0, 1), 42)])
    merged = {r.label: r.new_label for r in M.size_merge_mapping(df).collect()}
    assert merged[0] == merged[1] and len(set(merged.values())) == 3


def test_zero_centroid_has_no_cosine_distance(spark):
    centers = G.centroids(points(spark, [((0, 0), 1), ((1, 1), 2), ((1, 0), 2)]))
    found = D.pairwise_distances(centers).where("dist IS NOT NULL").collect()
    assert {(r.a, r.b) for r in found} == {(1, 2), (2, 1)}


def test_topk_ties_take_the_lower_index(spark):
    df = spark.createDataFrame([([0.25, 0.25, 0.25, 0.25],), ([0.1, 0.6, 0.3, 0.0],)], "p array<double>")
    rows = [r[0] for r in df.select(topk_renormalize(F.col("p"), 2)).collect()]
    assert rows[0] == [0.5, 0.5, 0.0, 0.0] and np.allclose(rows[1], [0, 2 / 3, 1 / 3, 0])


def test_lowest_rows_of_columns():
    ranks = np.round(np.random.RandomState(4).randn(300, 7), 1)
    ranks[5, 0] = ranks[9, 1] = np.nan
    for k in (1, 4, 299, 300, 400):
        assert (D._lowest(ranks, k) == np.argsort(ranks, axis=0, kind="stable")[:k]).all()


def test_top_words_over_many_batches(spark):
    random = np.random.RandomState(3)
    words = [(f"w{i}", [float(x) for x in random.randn(6)]) for i in range(400)]
    wv = spark.createDataFrame(words, "word string, vector array<double>").repartition(9)
    centers = [(i, [float(x) for x in random.randn(6)]) for i in range(3)]
    ours = D.top_words(spark.createDataFrame(centers, "label int, centroid array<double>"), wv, 4)
    found = {(r.label, r.rn): r.word for r in ours.collect()}
    for label, c in centers:
        cos = {w: np.dot(v, c) / np.linalg.norm(v) / np.linalg.norm(c) for w, v in words}
        assert [found[label, i] for i in range(1, 5)] == sorted(cos, key=lambda w: -cos[w])[:4]
