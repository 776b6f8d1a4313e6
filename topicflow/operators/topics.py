"""Topic models: clustering, latent features, classifiers, and the tree of topics.

All nodes of a level are fitted together (``node_fits``); a fitted tree is a set of small arrays, so that
rows are labelled at every level where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_array, topk_renormalize
from ..session import materialize
from . import node_fits as N
from .groups import encode_paths
from .mixtures import fit_mixtures

LATENT = 100
MAX_ITER = 10


def single_topic(df: DataFrame, topic: int = 0, label: str = "label") -> DataFrame:
    """The model of a node that merging left with one cluster: a constant."""
    return df.withColumn(label, F.lit(topic))


def _dimension(df: DataFrame, features: str = "features") -> int:
    row = df.select(F.size(as_array(F.col(features)))).first()
    return row[0] if row else 0


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _with_labels(df: DataFrame, label: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    own = F.arrow_udf(lambda v: pa.array(work(_matrix(v)).astype(np.int32)) if len(v) else pa.array([], pa.int32()), "int")
    return df.withColumn(label, own(as_array(F.col("features"))))


def _rows_per_node(rows: DataFrame) -> dict[int, int]:
    return dict(rows.groupBy("node").agg(F.count("*")).collect())  # as many as the level has nodes


def cluster(df: DataFrame, k: int = 20, seed: int = 45, label: str = "label") -> DataFrame:
    """Adds ``label``: k clusters by Ward linkage; one cluster when there are at most k rows.

    Rows are first summed up in cells, at least ``CELLS`` of them or 4 k, and the cells are linked: with
    no more different rows than cells this is Ward linkage of the rows, and copies share a cell.
    """
    rows = N.node_rows(df, seed=seed)
    counts = _rows_per_node(rows)
    if counts.get(0, 0) <= k:
        return single_topic(df, 0, label)
    cells = N.fit_cells(rows, counts, k)[0]
    labels = N.cut_merges(len(cells.counts), N.ward_merges(cells.counts, cells.means), k)
    return _with_labels(df, label, lambda x: labels[N.nearest(x, cells.centers)])


def fit_latent(df: DataFrame, size: int = LATENT, label: str = "label") -> N.Latent:
    """Features that separate the labels (dense from 0), see ``discriminant_features``."""
    rows = N.node_rows(df, label=label)
    labels = (rows.agg(F.max("label")).first()[0] or 0) + 1
    return N.discriminant_features(N.label_moments(rows, {0: labels})[0], size)


def latent_features(df: DataFrame, size: int = LATENT, label: str = "label") -> DataFrame:
    """Adds the array ``latent``, learned from ``features`` and ``label``."""
    latent = fit_latent(df, size, label)
    own = F.arrow_udf(lambda v: _lists(latent.of(_matrix(v)) if len(v) else np.zeros((0, 1))), "array<double>")
    return df.withColumn("latent", own(as_array(F.col("features"))))


def fit_classifier(df: DataFrame, label: str = "label", max_iter: int = MAX_ITER) -> N.Classifier:
    """Linear classifier on the array ``latent``; labels are dense from 0."""
    vectors = df.select(F.lit(0).alias("node"), F.col(label).cast("int").alias("label"), F.lit(0).cast("long").alias("draw"), F.col("latent").alias("features"))
    rows = materialize(vectors, name="latent")
    labels = rows.agg(F.max("label")).first()[0] + 1
    moments = N.label_moments(rows, {0: labels})
    # whitened and centred, as the classifier's start takes the features to be
    latents = {0: N.discriminant_features(moments[0], len(moments[0].gram))}
    found = N.fit_classifiers(rows, latents, moments, max_iter)[0]
    weights = latents[0].projection @ found.weights
    return N.Classifier(weights, found.offset - latents[0].mean @ weights)


def topic_classifier(df: DataFrame, label: str = "label", max_iter: int = MAX_ITER) -> DataFrame:
    """Adds ``topic`` and the array ``scores`` from a classifier fitted on ``latent`` and ``label``."""
    model = fit_classifier(df, label, max_iter)
    own = F.arrow_udf(lambda v: _lists(model.scores(_matrix(v)) if len(v) else np.zeros((0, 1))), "array<double>")
    scored = df.withColumn("scores", own("latent"))
    return scored.withColumn("topic", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))


@dataclass
class TopicNode:
    """One fitted node: a constant, or latent features with a classifier."""

    constant: int | None = None
    latent: N.Latent | None = None
    classifier: N.Classifier | None = None
    topic_count: int = 1

    def topics(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant, np.int32)
        return self.classifier.scores(self.latent.of(x)).argmax(axis=1).astype(np.int32)

    def predict(self, df: DataFrame, out: str = "topic") -> DataFrame:
        if self.constant is not None:
            return df.withColumn(out, F.lit(self.constant))
        return _with_labels(df, out, self.topics)

    def scores(self, df: DataFrame) -> DataFrame:
        own = F.arrow_udf(lambda v: _lists(self.classifier.scores(self.latent.of(_matrix(v))) if len(v) else np.zeros((0, 1))), "array<double>")
        return df.withColumn("scores", own(as_array(F.col("features"))))


def _fit_level(rows: DataFrame, k: int, latent: int, max_iter: int, q: int) -> dict[int, TopicNode]:
    """A fitted node for every node that has rows: cluster, merge close clusters, learn latent features and
    a classifier, merge small topics, learn both again.

    One cluster left by distance gives a constant node; one left by size keeps the first classifier.
    """
    counts = _rows_per_node(rows)
    fitted = {node: TopicNode(constant=0) for node in counts}
    cells = N.fit_cells(rows, {n: c for n, c in counts.items() if c > k}, k)
    labels: dict[int, np.ndarray] = {}
    for node, own in cells.items():
        clusters = N.cut_merges(len(own.counts), N.ward_merges(own.counts, own.means), k)
        sizes, sums = N.label_sums(own, clusters)
        merged = N.close_mapping(sums / sizes[:, None], q)[clusters]
        if merged.max() > 0:
            labels[node] = merged
    if not labels:
        return fitted
    by_cell = lambda node, _, x: labels[node][N.nearest(x, cells[node].centers)] if node in labels else None
    rows = N.relabelled(rows, by_cell)
    moments = N.label_moments(rows, {n: int(own.max()) + 1 for n, own in labels.items()})
    first = _fit_models(rows, moments, latent, max_iter)

    by_topic = lambda node, _, x: first[node].topics(x) if node in first else None
    rows = N.relabelled(rows, by_topic)
    moments = N.label_moments(rows, {n: m.topic_count for n, m in first.items()})
    mappings: dict[int, np.ndarray] = {}
    for node, m in moments.items():
        fitted[node] = first[node]
        used = np.flatnonzero(m.counts)  # topics without a row have no place
        centers = first[node].latent.of(m.sums[used] / m.counts[used, None])
        mapping = np.zeros(len(m.counts), np.int64)
        mapping[used] = N.small_mapping(m.counts[used], centers, q)
        if mapping.max() > 0:
            mappings[node] = mapping
    if mappings:
        rows = N.relabelled(rows, lambda node, own, x: mappings[node][own] if node in mappings else None)
        merged = {n: moments[n].merged(mapping) for n, mapping in mappings.items()}
        fitted.update(_fit_models(rows, merged, latent, max_iter))
    return fitted


def _fit_models(rows: DataFrame, moments: dict[int, N.Moments], latent: int, max_iter: int) -> dict[int, TopicNode]:
    latents = {n: N.discriminant_features(m, latent) for n, m in moments.items()}
    models = N.fit_classifiers(rows, latents, moments, max_iter)
    return {n: TopicNode(None, latents[n], models[n], len(moments[n].counts)) for n in models}


def fit_topic_node(
    df: DataFrame, k: int = 20, seed: int = 45, latent: int = LATENT, max_iter: int = MAX_ITER, q: int = 20
) -> TopicNode:
    """One node over all rows."""
    return _fit_level(N.node_rows(df, seed=seed), k, latent, max_iter, q).get(0, TopicNode(constant=0))


@dataclass
class TopicTree:
    """A node and the trees of its topics."""

    node: TopicNode
    children: dict[int, TopicTree] = field(default_factory=dict)

    @property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children.values()), default=0)

    def nodes(self, path: str = "") -> dict[str, TopicNode]:
        found = {path: self.node}
        for topic, child in self.children.items():
            found.update(child.nodes(f"{path}_{topic}".lstrip("_")))
        return found

    def labels(self, x: np.ndarray) -> np.ndarray:
        """A topic per row and level, -1 where a level is not reached."""
        found = np.full((len(x), self.depth), -1, np.int32)
        found[:, 0] = self.node.topics(x)
        for topic, child in self.children.items():
            own = np.flatnonzero(found[:, 0] == topic)
            if len(own):
                found[own, 1 : 1 + child.depth] = child.labels(x[own])
        return found

    def features(self, x: np.ndarray, size: int) -> np.ndarray:
        """The latent vectors of all levels side by side, NaN where a row has none."""
        found = np.full((len(x), self.depth * size), np.nan)
        if self.node.constant is None:
            own = self.node.latent.of(x)
            found[:, : own.shape[1]] = own
        topics = self.node.topics(x)
        for topic, child in self.children.items():
            own = np.flatnonzero(topics == topic)
            if len(own):
                found[own, size : size * (1 + child.depth)] = child.features(x[own], size)
        return found

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per node with its arrays."""
        rows = []
        for p, n in self.nodes().items():
            arrays = [None] * 4
            if n.constant is None:
                arrays = [a.astype(float).ravel().tolist() for a in (n.latent.mean, n.latent.projection, n.classifier.weights, n.classifier.offset)]
            rows.append((p, n.constant, n.topic_count, *arrays))
        arrays = ", ".join(f"{c} array<double>" for c in ("mean", "projection", "weights", "offset"))
        schema = f"path string, constant int, topic_count int, {arrays}"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicTree:
        trees: dict[str, TopicTree] = {}
        for row in sorted(spark.read.parquet(path).collect(), key=lambda r: r.path.count("_") + bool(r.path)):
            node = TopicNode(row.constant, topic_count=row.topic_count)
            if row.constant is None:
                mean, projection, weights, offset = (np.array(a, float) for a in (row.mean, row.projection, row.weights, row.offset))
                node.latent = N.Latent(mean, projection.reshape(len(mean), -1))
                node.classifier = N.Classifier(weights.reshape(-1, len(offset)), offset)
            trees[row.path] = cls(node)
            if row.path:
                parent, _, topic = row.path.rpartition("_")
                trees[parent].children[int(topic)] = trees[row.path]
        return trees[""]


def fit_topic_tree(
    df: DataFrame, max_depth: int = 2, k: int = 20, seed: int = 45, latent: int = LATENT, max_iter: int = MAX_ITER, q: int = 20
) -> TopicTree:
    """Fit the root, then all nodes of a level at once, a child per topic of every node, down to ``max_depth``."""
    rows = N.node_rows(df, seed=seed)
    tree = TopicTree(_fit_level(rows, k, latent, max_iter, q).get(0, TopicNode(constant=0)))
    level = {0: tree}
    for _ in range(max_depth - 1):
        # children are numbered through, topics of a node next to each other
        first = dict(zip(level, np.cumsum([0, *(t.node.topic_count for t in level.values())]).tolist()))
        parents = {n: t.node for n, t in level.items()}
        rows = N.regrouped(rows, lambda node, _, x: parents[node].topics(x) + first[node])
        fitted = _fit_level(rows, k, latent, max_iter, q)
        below: dict[int, TopicTree] = {}
        for n, parent in level.items():
            for topic in range(parent.node.topic_count):
                if first[n] + topic in fitted:
                    below[first[n] + topic] = parent.children[topic] = TopicTree(fitted[first[n] + topic])
        level = below
    return tree


def predict_topics(df: DataFrame, tree: TopicTree, key: str = "url") -> DataFrame:
    """(key, l0, l1, ...): label per level, null where a level is not reached.

    The whole tree goes to the tasks (a projection and a classifier per node), so no row is moved.
    """
    depth = tree.depth
    shared = df.sparkSession.sparkContext.broadcast(tree)

    def work(vectors: pa.Array) -> pa.Array:
        found = shared.value.labels(_matrix(vectors)) if len(vectors) else np.zeros((0, depth), np.int32)
        columns = [pa.array(c, pa.int32(), mask=c < 0) for c in found.T]
        return pa.StructArray.from_arrays(columns, [f"l{i}" for i in range(depth)])

    own = F.arrow_udf(work, ", ".join(f"l{i} int" for i in range(depth)))
    labelled = df.select(key, own(as_array(F.col("features"))).alias("_labels"))
    return labelled.select(key, *(F.col(f"_labels.l{i}").alias(f"l{i}") for i in range(depth)))


def extract_topic_features(df: DataFrame, tree: TopicTree, size: int = LATENT, key: str = "url") -> DataFrame:
    """(key, features): the latent vectors of all levels side by side, NaN where not reached."""
    size = min(size, _dimension(df))
    shared = df.sparkSession.sparkContext.broadcast(tree)
    own = F.arrow_udf(lambda v: _lists(shared.value.features(_matrix(v), size) if len(v) else np.zeros((0, 1))), "array<double>")
    return df.select(key, own(as_array(F.col("features"))).alias("features"))


def concat_level_features(df: DataFrame, levels: Sequence[str], key: str = "url") -> DataFrame:
    return df.select(key, F.concat(*levels).alias("features"))


def choose_k(df: DataFrame, ks: Sequence[int], seed: int = 45) -> DataFrame:
    """(k, clusters, score, best) per tried k; stops at a one-cluster result, which then wins.

    All k are cuts of one linkage.  The score is null where no row lies off its cluster's mean, or where there
    is one cluster; a null is never best unless all are, then the first k is.
    """
    rows = N.node_rows(df, seed=seed)
    counts = _rows_per_node(rows)
    tried: list[tuple[int, int, float | None]] = []
    cells, merges = None, []
    if counts.get(0, 0) > min(ks):
        cells = N.fit_cells(rows, counts, max(ks))[0]
        merges = N.ward_merges(cells.counts, cells.means)
    for k in ks:
        if counts.get(0, 0) <= k:
            tried.append((k, 1, None))
            break
        labels = N.cut_merges(len(cells.counts), merges, k)
        tried.append((k, int(labels.max()) + 1, N.dispersion_ratio(cells, labels)))
        if tried[-1][1] == 1:
            break
    if tried[-1][1] == 1:
        best = tried[-1][0]
    else:
        best = max(tried, key=lambda t: float("-inf") if t[2] is None else t[2])[0]
    return df.sparkSession.createDataFrame(
        [(*t, t[0] == best) for t in tried], "k int, clusters long, score double, best boolean"
    )


def soft_clusters(
    df: DataFrame, k: int, seed: int = 45, top: int | None = None, max_iter: int = 30, label: str = "label"
) -> DataFrame:
    """Adds ``probabilities`` (optionally only the ``top`` largest, renormalized) and the hard label: the
    posterior of a Gaussian mixture, see ``fit_mixtures``."""
    model = fit_mixtures(N.node_rows(df, seed=seed), k, max_iter).get(0)
    posterior = F.arrow_udf(
        lambda v: _lists(model.posterior(_matrix(v))) if len(v) else _lists(np.zeros((0, k))), "array<double>"
    )
    scored = df.withColumn("probabilities", posterior(as_array(F.col("features"))))
    largest = F.array_position("probabilities", F.array_max("probabilities")) - 1
    scored = scored.withColumn(label, largest.cast("int"))
    if top is None:
        return scored
    return scored.withColumn("probabilities", topk_renormalize(F.col("probabilities"), top))


def soft_cluster_tree(df: DataFrame, ks: Sequence[int], key: str = "url", seed: int = 45, max_iter: int = 30) -> DataFrame:
    """(key, l0, l1, ..., topic_path, code): nested soft clusters, -1 where a level is not reached.

    The mixtures of a level are fitted together; a node with at most k rows is not split.
    """
    rows = N.node_rows(df, seed=seed)
    models: list[dict[int, object]] = []
    for level, k in enumerate(ks):
        counts = _rows_per_node(rows)
        split = {n for n, c in counts.items() if c > k}
        fitted = fit_mixtures(rows.where(F.col("node").isin(sorted(split))), k, max_iter)
        models.append(fitted)
        if level + 1 < len(ks):
            step = lambda node, _, x, m=fitted, k=k: m[node].labels(x) + node * k if node in m else np.full(len(x), node * k)
            rows = N.regrouped(rows, step)
    shared = df.sparkSession.sparkContext.broadcast(models)

    def work(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors) if len(vectors) else np.zeros((0, 1))
        found, node = np.full((len(x), len(ks)), -1, np.int32), np.zeros(len(x), np.int64)
        for level, (k, own) in enumerate(zip(ks, shared.value)):
            for n in np.unique(node).tolist():
                at = np.flatnonzero(node == n)
                if n in own:
                    found[at, level] = own[n].labels(x[at])
                elif level == 0:
                    found[at, level] = 0
            node = node * k + np.maximum(found[:, level], 0)
        return pa.StructArray.from_arrays([pa.array(c) for c in found.T], [f"l{i}" for i in range(len(ks))])

    levels = [f"l{i}" for i in range(len(ks))]
    own = F.arrow_udf(work, ", ".join(f"{c} int" for c in levels))
    labelled = df.select(key, own(as_array(F.col("features"))).alias("_labels")).select(key, *(F.col(f"_labels.{c}").alias(c) for c in levels))
    paths = labelled.withColumn("topic_path", F.concat_ws("_", *(F.col(c).cast("string") for c in levels)))
    return encode_paths(materialize(paths, name="paths"), "topic_path", [key])


def project_2d(df: DataFrame, label: str = "label", key: str = "url") -> tuple[DataFrame, DataFrame]:
    """(coordinates per row, center per label) on the two leading principal components."""
    flat = PCA(k=2, inputCol="features", outputCol="flat").fit(df).transform(df)
    xy = as_array(F.col("flat"))
    points = flat.select(key, label, xy[0].alias("x"), xy[1].alias("y"))
    return points, points.groupBy(label).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
