"""Level-wise fits, Ward linkage, discriminant features, mixtures and word vectors against slow versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicflow.functions.vectors import as_array, as_vector
from topicflow.operators import groups, merge, mixtures, word_vectors
from topicflow.operators import node_fits as N
from topicflow.operators import topics as T
from topicflow.operators.distances import pairwise_distances


def frame(spark, x, **columns):
    names = list(columns)
    rows = [(i, [float(v) for v in row], *(columns[c][i] for c in names)) for i, row in enumerate(x)]
    schema = "id long, v array<double>" + "".join(f", {c} int" for c in names)
    return spark.createDataFrame(rows, schema).select("id", as_vector(F.col("v")).alias("features"), *names)


def brute_ward(x, k):
    """Clusters of the rows, merged pair by cheapest pair."""
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > k:
        best = None
        for i in range(len(clusters)):
            for j in range(i + 1, len(clusters)):
                a, b = x[clusters[i]], x[clusters[j]]
                cost = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(axis=0) - b.mean(axis=0)) ** 2).sum()
                if best is None or cost < best[0] - 1e-12:
                    best = cost, i, j
        clusters[best[1]] += clusters.pop(best[2])
    return {frozenset(c) for c in clusters}


def partition(rows, label="label"):
    found = {}
    for r in rows:
        found.setdefault(r[label], set()).add(r.id)
    return {frozenset(v) for v in found.values()}


@pytest.mark.parametrize("k", [3, 7])
def test_ward_of_single_rows_is_ward_of_the_rows(spark, k):
    random = np.random.default_rng(k)
    x = np.vstack([random.normal(c, 1.0, (12, 5)) for c in (0, 2, 5, 9)])
    x = np.vstack([x, x[:5], x[:1]])  # copies
    assert partition(T.cluster(frame(spark, x).repartition(5), k).collect()) == brute_ward(x, k)


def test_more_rows_than_cells_find_separate_blobs(spark):
    random = np.random.default_rng(2)
    truth = random.integers(0, 6, 4000)
    x = random.normal(0, 0.3, (4000, 8)) + np.eye(8)[truth] * 6
    x[:1500] = x[0]  # one vector holds a third of all rows
    truth[:1500] = truth[0]
    found = T.cluster(frame(spark, x), 6).collect()
    assert partition(found) == {frozenset(np.flatnonzero(truth == c).tolist()) for c in range(6)}


def test_merge_rules_equal_the_operators(spark):
    random = np.random.default_rng(4)
    for trial in range(3):
        labels = 14
        x = random.normal(0, 1, (400, 6)) + random.normal(0, 2 + trial, (labels, 6))[(own := random.zipf(1.4, 400) % labels)]
        df = frame(spark, x, label=own.tolist())
        used, dense = np.unique(own, return_inverse=True)
        centers = np.stack([x[dense == i].mean(axis=0) for i in range(len(used))])
        sizes = np.bincount(dense)
        spark_map = {r.label: r.new_label for r in merge.distance_merge_mapping(df).collect()}
        assert [spark_map[u] for u in used] == N.close_mapping(centers).tolist()
        spark_map = {r.label: r.new_label for r in merge.size_merge_mapping(df).collect()}
        assert [spark_map[u] for u in used] == N.small_mapping(sizes, centers).tolist()
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "label int, centroid array<double>")
        threshold = groups.largest_gap_threshold(groups.quantile_bins(pairwise_distances(table), "dist")).first().threshold
        distances = N._cosine_distances(centers)
        assert N.gap_threshold(distances[~np.isnan(distances)]) == pytest.approx(threshold, abs=1e-12)
    assert N.gap_threshold(np.array([])) is None and N.gap_threshold(np.ones(9)) is None


def test_features_use_the_labels(spark):
    """Two labels differ in a direction of little variance, which leading principal components leave out."""
    random = np.random.default_rng(7)
    label = random.integers(0, 2, 600)
    x = random.normal(0, 1, (600, 6)) * np.array([50, 40, 30, 20, 0.05, 10])
    x[:, 4] += label
    df = frame(spark, x, label=label.tolist())
    rows = T.latent_features(df, 1).collect()
    z = np.array([r.latent[0] for r in rows])
    own = np.array([r.label for r in rows])
    gap = abs(z[own == 1].mean() - z[own == 0].mean())
    assert gap > 10 * z[own == 0].std()
    principal = x @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    assert abs(principal[label == 1].mean() - principal[label == 0].mean()) < principal.std()
    scored = T.topic_classifier(T.latent_features(df, 3)).collect()
    assert all(r.topic == r.label for r in scored)


def test_classifier_likelihood_never_falls(spark):
    random = np.random.default_rng(8)
    label = random.integers(0, 3, 500)
    x = random.normal(0, 1.2, (500, 4)) + np.eye(4)[label] * 2
    df = frame(spark, x, label=label.tolist())
    latent = T.latent_features(df, 4).select("id", "label", "latent")
    z = np.array([r.latent for r in latent.orderBy("id").collect()])
    losses = []
    for rounds in (0, 1, 2, 5, 20):
        scores = T.fit_classifier(latent, max_iter=rounds).scores(z)
        logs = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
        losses.append(-logs[np.arange(500), label].mean())
    assert all(b <= a + 1e-6 for a, b in zip(losses, losses[1:]))


def test_a_level_equals_its_nodes_fitted_alone(spark):
    random = np.random.default_rng(9)
    centers = np.array([[10, 0, 0, 0, 0], [-10, 0, 0, 0, 0], [0, 0, 12, 0, 0]])
    inner = np.array([[0, 3, 0, 0, 0], [0, -3, 0, 0, 0], [0, 0, 0, 3, 0], [0, 0, 0, 0, 3]])
    x = np.vstack([random.normal(0, 0.2, (40, 5)) + c + d for c in centers for d in inner])
    df = frame(spark, x)
    options = {"k": 8, "latent": 4, "max_iter": 5}
    tree = T.fit_topic_tree(df, 2, **options)
    root = T.fit_topic_node(df, **options)
    top = {r.id: r.topic for r in root.predict(df).collect()}
    labels = {r.id: r for r in T.predict_topics(df, tree, "id").collect()}
    assert {i: r.l0 for i, r in labels.items()} == top
    for topic in range(root.topic_count):
        own = df.where(F.col("id").isin([i for i, t in top.items() if t == topic]))
        alone = T.fit_topic_node(own, **options)
        assert alone.topic_count == tree.children[topic].node.topic_count
        assert {r.id: r.topic for r in alone.predict(own).collect()} == {i: r.l1 for i, r in labels.items() if r.l0 == topic}
    assert len({(r.l0, r.l1) for r in labels.values()}) > root.topic_count


def test_choose_k_of_few_points(spark):
    x = np.repeat(np.eye(6), 4, axis=0)
    found = {r.k: (r.clusters, r.score, r.best) for r in T.choose_k(frame(spark, x), [5, 10]).collect()}
    assert found[10] == (6, None, False) and found[5][0] == 5 and found[5][2]
    assert [tuple(r) for r in T.choose_k(frame(spark, x[:2]), [5, 10]).collect()] == [(5, 1, None, True)]


def test_choose_k_scores_equal_the_ratio_of_the_rows(spark):
    random = np.random.default_rng(1)
    df = frame(spark, random.normal(0, 1, (300, 4)) + np.eye(4)[random.integers(0, 4, 300)] * 4)
    for r in T.choose_k(df, [2, 4, 9]).collect():
        assert r.score == pytest.approx(groups.calinski_harabasz(T.cluster(df, r.k)).first().score, rel=1e-6)


def numpy_em(x, model, rounds):
    shares, means, variances = model.shares.copy(), model.means.copy(), model.variances.copy()
    for _ in range(rounds):
        logs = np.stack([
            math.log(s) - 0.5 * (((x - m) ** 2 / v).sum(axis=1) + np.log(2 * np.pi * v).sum()) for s, m, v in zip(shares, means, variances)
        ], axis=1)
        post = np.exp(logs - np.logaddexp.reduce(logs, axis=1)[:, None])
        shares = post.mean(axis=0)
        means = (post.T @ x) / post.sum(axis=0)[:, None]
        variances = np.stack([(post[:, i, None] * (x - means[i]) ** 2).sum(axis=0) / post[:, i].sum() for i in range(len(shares))])
        variances = np.maximum(variances, model.floor)
    return shares, means, variances


def test_mixture_equals_numpy(spark):
    random = np.random.default_rng(3)
    which = random.integers(0, 3, 500)
    x = random.normal(0, 1, (500, 4)) * np.array([0.3, 1, 2])[which, None] + np.eye(4)[which] * 3
    rows = N.node_rows(frame(spark, x).repartition(6))
    start = mixtures.fit_mixtures(rows, 3, 0)[0]
    fitted = mixtures.fit_mixtures(rows, 3, 8, tolerance=-1.0)[0]
    for ours, theirs in zip((fitted.shares, fitted.means, fitted.variances), numpy_em(x, start, 8)):
        assert np.allclose(ours, theirs, rtol=1e-6, atol=1e-8)
    assert all(b >= a - 1e-9 for a, b in zip(fitted.likelihoods, fitted.likelihoods[1:]))


def test_mixture_of_copies_has_no_nan(spark):
    rows = T.soft_clusters(frame(spark, np.ones((30, 3))), 4).collect()
    assert all(sum(r.probabilities) == pytest.approx(1) for r in rows)


# word vectors

TEXTS = ["cat sat mat cat cat", "dog sat log", "cat dog", "", "rare", "mat log mat dog sat cat mat", "$$$STUB$$$"] * 3 + ["once upon cat"]


def brute_pairs(texts, window, min_count):
    docs = [t.split(" ") for t in texts]
    counts = Counter(w for d in docs for w in d if w)
    n, degree = Counter(), Counter()
    for d in docs:
        for i in range(len(d)):
            for j in range(i + 1, min(len(d), i + window + 1)):
                n[tuple(sorted((d[i], d[j])))] += (window + 1 - (j - i)) * (2 if d[i] == d[j] else 1)
    for (a, b), m in n.items():
        degree[a] += m
        if a != b:
            degree[b] += m
    total = sum(degree.values())
    known = {p: m for p, m in n.items() if all(counts[w] >= min_count for w in p)}
    pmi = {p: math.log(m * total / (degree[p[0]] * degree[p[1]])) for p, m in known.items()}
    return counts, {p: (known[p], v) for p, v in pmi.items() if v > 0}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "url int, cleaned string")


def test_associations_equal_brute_force(texts):
    found = {(r.word, r.other): (r.n, r.pmi) for r in word_vectors.word_associations(texts, 3).collect()}
    _, expected = brute_pairs(TEXTS, 3, 2)
    assert found.keys() == expected.keys()
    for pair, (n, pmi) in expected.items():
        assert found[pair] == (n, pytest.approx(pmi, abs=1e-12))


@pytest.mark.parametrize("block, strip, tile", [(1 << 15, 64, 1 << 17), (2, 3, 4)])
def test_vectors_factor_the_associations(texts, monkeypatch, block, strip, tile):
    """With as many numbers as words the products of the vectors give the matrix's absolute value."""
    monkeypatch.setattr(word_vectors, "BLOCK_WORDS", block)
    monkeypatch.setattr(word_vectors, "STRIP", strip)
    monkeypatch.setattr(word_vectors, "TILE_CELLS", tile)
    counts, pairs = brute_pairs(TEXTS, 5, 2)
    words = sorted(w for w, c in counts.items() if c >= 2)
    matrix = np.zeros((len(words), len(words)))
    for (a, b), (_, pmi) in pairs.items():
        matrix[words.index(a), words.index(b)] = matrix[words.index(b), words.index(a)] = pmi
    found = {r.word: r.vector for r in word_vectors.fit_word_vectors(texts, size=20).collect()}
    assert sorted(found) == words and all(len(v) == 20 for v in found.values())
    x = np.array([found[w] for w in words])
    values, vectors = np.linalg.eigh(matrix)
    assert np.allclose(x @ x.T, (vectors * np.abs(values)) @ vectors.T, atol=1e-3)


def test_groups_of_blocks_share_the_factor(texts, monkeypatch):
    """Several blocks of rows to a task: the same product, the factor moved once per group instead of once per block."""
    monkeypatch.setattr(word_vectors, "BLOCK_WORDS", 2)
    monkeypatch.setattr(word_vectors, "STRIP", 3)
    moved, found = [], []
    repartition = type(texts).repartition

    def counted(df, n, *columns):
        if "strip" in columns:
            moved.append(df.where("payload IS NOT NULL").count())
        return repartition(df, n, *columns)

    monkeypatch.setattr(type(texts), "repartition", counted)
    for tasks in (1, 1 << 20):
        monkeypatch.setattr(word_vectors, "PRODUCT_TASKS", tasks)
        found.append({r.word: np.array(r.vector) for r in word_vectors.fit_word_vectors(texts, size=8).collect()})
    assert moved[0] < moved[3] and len(moved) == 6
    assert found[0].keys() == found[1].keys() and all(np.allclose(v, found[1][w], atol=1e-6) for w, v in found[0].items())


def test_rows_of_cells_are_multiplied_together(monkeypatch):
    """A sparse block times a factor: to the bit what ``reduceat`` gives, with a few gathers instead of one per so many cells."""
    random = np.random.default_rng(4)
    counts = np.concatenate([random.integers(0, 12, 3000), [500, 40, 40]])
    rows = np.repeat(np.arange(len(counts)), counts)
    b = random.integers(0, 700, len(rows))
    v, factor = random.random(len(rows)).astype(np.float32), random.random((700, 5)).astype(np.float32)
    begins = np.diff(rows, prepend=-1) != 0
    begins[::128] = True
    expected, total = np.ones((len(counts), 5), np.float32), np.ones((len(counts), 5), np.float32)
    for at in range(0, len(rows), 128):
        cut = slice(at, at + 128)
        first = np.flatnonzero(np.diff(rows[cut], prepend=-1))
        expected[rows[cut][first]] += np.add.reduceat(factor[b[cut]] * v[cut, None], first, axis=0)
    gathers, take = [], np.take
    monkeypatch.setattr(np, "take", lambda *a, **k: gathers.append(1) or take(*a, **k))
    word_vectors._add_rows(total, rows, b, v, begins, factor)
    assert (total == expected).all()
    assert 0 < len(gathers) < 200 < len(counts)


def test_a_cell_moves_as_one_number(texts):
    """Tiles are dealt and sorted by one place and hold all cells, in their order, whatever the blocks."""
    cells = [(i, a, j, b, float(i + a + j + b)) for i in range(3) for j in range(3) for a in (0, 4095, 4096, 40000) for b in (1, 65535)]
    df = texts.sparkSession.createDataFrame(cells, "block_a int, slot_a int, block_b int, slot_b int, pmi double")
    found = []
    for t in word_vectors._tiles(df, 3).collect():
        a, b, v = np.frombuffer(t.a, np.uint16), np.frombuffer(t.b, np.uint16), np.frombuffer(t.v, np.float32)
        assert (np.diff(a.astype(int) * 65536 + b) >= 0).all() and set(a // 4096) == {t.rows}
        found += [(t.i, int(x), t.j, int(y), float(n)) for x, y, n in zip(a, b, v)]
    assert sorted(found) == sorted(cells + [(j, b, i, a, n) for i, a, j, b, n in cells])


def test_batches_of_strips_make_the_same_vectors(texts, monkeypatch):
    """One strip at a time, or narrow strips for a few wide groups: less on disk at once, the same numbers."""
    monkeypatch.setattr(word_vectors, "BLOCK_WORDS", 2)
    monkeypatch.setattr(word_vectors, "STRIP", 3)
    monkeypatch.setattr(word_vectors, "BATCH_TASKS", 1 << 20)
    batches, found = [], []
    batch = word_vectors._batch

    def counted(tiles, vectors, sizes, layout, strips, signs):
        batches.append((layout.width, layout.wide, len(strips)))
        return batch(tiles, vectors, sizes, layout, strips, signs)

    monkeypatch.setattr(word_vectors, "_batch", counted)
    for most, groups in ((1 << 30, 16), (1, 16), (1, 2)):
        monkeypatch.setattr(word_vectors, "BATCH_BYTES", most)
        monkeypatch.setattr(word_vectors, "MOST_GROUPS", groups)
        found.append({r.word: r.vector for r in word_vectors.fit_word_vectors(texts, size=8).collect()})
    assert [b[2] for b in batches[:3]] == [3] * 3 and all(b == (3, 1, 1) for b in batches[3:12])
    assert len(batches) > 12 and all(b[0] == 1 and b[1] > 1 and b[2] == 1 for b in batches[12:])
    assert found[0] == found[1] == found[2]


def test_vectors_do_not_depend_on_partitions(spark):
    random = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{int(w)}" for w in random.zipf(1.3, 40) % 300)) for i in range(400)]
    df = spark.createDataFrame(rows, "url int, cleaned string")
    found = []
    for parts in (2, 20):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({r.word: np.array(r.vector) for r in word_vectors.fit_word_vectors(df.repartition(parts), size=50).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert found[0].keys() == found[1].keys()
    assert max(np.abs(found[0][w] - found[1][w]).max() for w in found[0]) < 1e-6


def test_no_words_no_vectors(spark):
    none = spark.createDataFrame([], "url int, cleaned string")
    assert word_vectors.fit_word_vectors(none).collect() == []
    alone = spark.createDataFrame([(0, "a"), (1, "a")], "url int, cleaned string")
    assert [(r.word, set(r.vector)) for r in word_vectors.fit_word_vectors(alone, size=3).collect()] == [("a", {0.0})]


def test_classifier_passes_read_latent_features(spark, monkeypatch):
    """The passes read as many numbers a row as there are latent features, and fit what passes over the vectors would."""
    from topicflow.operators import node_fits

    random = np.random.default_rng(8)
    x = random.normal(size=(120, 12)) + 3 * np.eye(12)[np.arange(120) % 3]
    data = [(n, i % 3, 0, v.tolist()) for n in (0, 4) for i, v in enumerate(x * (n + 1))]
    rows = spark.createDataFrame([*data, (9, 0, 0, x[0].tolist())], "node int, label int, draw long, features array<double>").repartition(3)
    moments = node_fits.label_moments(rows, {0: 3, 4: 3})
    latents = {n: node_fits.discriminant_features(m, 5) for n, m in moments.items()}
    widths, summed = [], node_fits.summed

    def seen(table, statistic):
        widths.append({len(r.features) for r in table.select("features").collect()})
        return summed(table, statistic)

    monkeypatch.setattr(node_fits, "summed", seen)
    found = node_fits.fit_classifiers(rows, latents, moments, 4)
    assert widths == [{5}] * 4 and found.keys() == {0, 4}
    for node, own in found.items():
        latent, m, labels = latents[node], moments[node], np.arange(120) % 3
        z = np.hstack([latent.of(x * (node + 1)), np.ones((120, 1))])
        means = latent.of(m.sums / m.counts[:, None])
        theta = np.vstack([means.T, np.log(m.counts / 120) - 0.5 * (means**2).sum(axis=1)])
        square = np.eye(6)
        square[:5, :5] = latent.projection.T @ m.scatter()[0] @ latent.projection
        step = np.linalg.inv(0.5 * square + node_fits.DECAY * np.eye(6))
        for _ in range(4):
            shares = np.exp(z @ theta)
            slope = z.T @ (np.eye(3)[labels] - shares / shares.sum(axis=1, keepdims=True)) / 120
            slope[:-1] -= node_fits.DECAY * theta[:-1]
            theta = theta + step @ slope
        assert np.allclose(np.vstack([own.weights, own.offset]), theta, atol=1e-9)
