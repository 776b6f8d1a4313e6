"""Fits of all nodes of a tree level at once.

The rows of a level are one stage table (node, label, draw, features).  A pass reads it once and adds up
a statistic of fixed size per node, first in each task, then by node; the driver turns the sums of all
nodes into their next parameters.  The number of passes depends on the depth of the tree, not on the
number of nodes, and what reaches the driver depends on nodes, dimensions and cells, not on rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_array
from ..session import discard, materialize
from .merge import overlapping_groups

# cells that summarize a node's rows before they are joined to clusters, and of all nodes of a level
CELLS = 512
LEVEL_CELLS = 8192
CELL_ROUNDS = 3
RIDGE = 1e-3
DECAY = 1e-4

Statistic = Callable[[int, np.ndarray, np.ndarray], "np.ndarray | None"]


def node_rows(df: DataFrame, features: str = "features", label: str | None = None, seed: int = 45) -> DataFrame:
    """(node, label, draw, features) of a vector column, all in node 0; equal vectors have equal draws."""
    vector = as_array(F.col(features))
    own = F.col(label).cast("int") if label else F.lit(0)
    rows = df.select(F.lit(0).alias("node"), own.alias("label"), F.xxhash64(vector, F.lit(seed)).alias("draw"), vector.alias("features"))
    return materialize(rows, name="rows")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, draws, labels, vectors) of a batch of rows, node by node."""
    if not batch.num_rows:
        return
    nodes, labels, draws = (batch.column(c).to_numpy() for c in ("node", "label", "draw"))
    vectors = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
    found = np.unique(nodes)
    if len(found) == 1:
        yield int(found[0]), draws, labels, vectors
        return
    order = np.argsort(nodes, kind="stable")
    cuts = np.searchsorted(nodes[order], found[1:])
    for node, own in zip(found.tolist(), np.split(order, cuts)):
        yield node, draws[own], labels[own], vectors[own]


def _added(pairs: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    totals: dict[int, np.ndarray] = {}
    for node, value in pairs:
        totals[node] = totals[node] + value if node in totals else np.array(value, np.float64)
    payload = [totals[n].tobytes() for n in totals]
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(payload, pa.binary())], ["node", "payload"])


def summed(rows: DataFrame, statistic: Statistic) -> dict[int, np.ndarray]:
    """The sum over each node's rows of ``statistic(node, labels, vectors)``, flat; nodes for which it
    gives None are left out."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = ((node, statistic(node, labels, x)) for batch in batches for node, _, labels, x in _parts(batch))
        yield _added((node, value.ravel()) for node, value in values if value is not None)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _added(
            (node, np.frombuffer(payload))
            for batch in batches
            for node, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        )

    each = rows.mapInArrow(first, "node int, payload binary").repartition("node")
    return {r.node: np.frombuffer(r.payload) for r in each.mapInArrow(again, "node int, payload binary").collect()}


def relabelled(rows: DataFrame, label: Statistic, name: str = "labelled") -> DataFrame:
    """The rows with the labels that ``label(node, labels, vectors)`` gives; None leaves the node's rows out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, draws, labels, x in _parts(batch):
                new = label(node, labels, x)
                if new is not None:
                    yield _row_batch(np.full(len(x), node, np.int32), new, draws, x)

    return materialize(rows.mapInArrow(work, rows.schema), name=name)


def regrouped(rows: DataFrame, node: Statistic) -> DataFrame:
    """The rows moved to the nodes that ``node(node, labels, vectors)`` gives; None leaves them out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, draws, labels, x in _parts(batch):
                new = node(own, labels, x)
                if new is not None:
                    yield _row_batch(new, np.zeros(len(x), np.int32), draws, x)

    return materialize(rows.mapInArrow(work, rows.schema), name="level")


def _row_batch(nodes: np.ndarray, labels: np.ndarray, draws: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
    columns = [pa.array(nodes.astype(np.int32)), pa.array(labels.astype(np.int32)), pa.array(draws), lists]
    return pa.RecordBatch.from_arrays(columns, ["node", "label", "draw", "features"])


# cells


def _seeds(rows: DataFrame, counts: dict[int, int], cells: int) -> dict[int, np.ndarray]:
    """At most ``cells`` different vectors per node, those with the smallest draws."""
    # four times as many draws as needed are expected below these limits
    limits = {n: int(2**64 * min(1.0, 4 * cells / c)) - 2**63 - 1 for n, c in counts.items()}

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[int]] = {}
        for batch in batches:
            for node, draws, _, x in _parts(batch):
                if node not in limits:
                    continue
                mine = seen.setdefault(node, set())
                for i in np.flatnonzero(draws <= limits[node]).tolist():
                    if int(draws[i]) not in mine:
                        mine.add(int(draws[i]))
                        columns = [pa.array([node], pa.int32()), pa.array([draws[i]]), pa.array([x[i].tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["node", "draw", "vector"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, draw, n = None, None, 0
        for batch in batches:
            keep = []
            for i, (node, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if node != at:
                    at, draw, n = node, None, 0
                if own != draw and n < cells:
                    keep.append(i)
                    draw, n = own, n + 1
            yield batch.take(pa.array(keep, pa.int64()))

    schema = "node int, draw long, vector binary"
    picked = rows.mapInArrow(chosen, schema).repartition("node").sortWithinPartitions("node", "draw").mapInArrow(least, schema)
    found: dict[int, list[np.ndarray]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r.node, r.draw)):  # LEVEL_CELLS rows or so
        found.setdefault(row.node, []).append(np.frombuffer(row.vector))
    return {node: np.stack(own) for node, own in found.items()}


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The closest center of each row, the first of equal ones."""
    return np.argmin((centers**2).sum(axis=1) - 2 * (x @ centers.T), axis=1)


@dataclass
class Cells:
    """Clustering features of a node: centers that assign rows, and counts, sums and squares of what they got."""

    centers: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return self.sums / self.counts[:, None]


def _cell_sums(rows: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    def statistic(node: int, _: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        if node not in centers:
            return None
        own = nearest(x, centers[node])
        out = np.zeros((len(centers[node]), x.shape[1] + 2))
        out[:, 0] = np.bincount(own, minlength=len(out))
        out[:, 1] = np.bincount(own, (x**2).sum(axis=1), len(out))
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        out[own[order][first], 2:] = np.add.reduceat(x[order], first, axis=0)
        return out

    found = summed(rows, statistic)
    return {n: found[n].reshape(len(c), -1) for n, c in centers.items()}


def fit_cells(rows: DataFrame, counts: dict[int, int], least: int) -> dict[int, Cells]:
    """Cells of every node in ``counts``: a node with no more different rows than cells has one for each."""
    if not counts:
        return {}
    cells = max(4 * least, min(CELLS, LEVEL_CELLS // len(counts)))
    centers = _seeds(rows, counts, cells)
    whole = all(counts[n] <= cells for n in centers)  # then every row is the center of its cell
    for round_ in range(1 if whole else CELL_ROUNDS):
        sums = _cell_sums(rows, centers)
        filled = {n: s[s[:, 0] > 0] for n, s in sums.items()}
        if round_ < CELL_ROUNDS - 1 and not whole:
            centers = {n: s[:, 2:] / s[:, :1] for n, s in filled.items()}
    kept = {n: centers[n][sums[n][:, 0] > 0] for n in centers}
    return {n: Cells(kept[n], filled[n][:, 0], filled[n][:, 2:], filled[n][:, 1]) for n in centers}


# Ward linkage of cells


def ward_merges(counts: np.ndarray, means: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of all merges by rising height, a and b being cells of the two clusters; by chains of
    nearest neighbours, on sizes and means."""
    sizes, centers = counts.astype(float).copy(), means.astype(float).copy()
    active = np.ones(len(sizes), bool)
    merges, chain = [], []
    while active.sum() > 1:
        if not chain:
            chain = [int(np.argmax(active))]
        while True:
            tip = chain[-1]
            cost = sizes * sizes[tip] / (sizes + sizes[tip]) * ((centers - centers[tip]) ** 2).sum(axis=1)
            cost[~active] = np.inf
            cost[tip] = np.inf
            other = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[other]:
                other = chain[-2]
                break
            chain.append(other)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((float(cost[other]), a, b))
        centers[a] = (sizes[a] * centers[a] + sizes[b] * centers[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        active[b] = False
    return sorted(merges, key=lambda m: m[0])


def cut_merges(cells: int, merges: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """A label per cell from the lowest merges that leave ``k`` clusters, numbered by first cell."""
    parent = list(range(cells))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in merges[: max(cells - k, 0)]:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return np.unique([find(i) for i in range(cells)], return_inverse=True)[1]


def label_sums(cells: Cells, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums) per label of the cells."""
    k = int(labels.max()) + 1
    sums = np.zeros((k, cells.sums.shape[1]))
    np.add.at(sums, labels, cells.sums)
    return np.bincount(labels, cells.counts, k), sums


def dispersion_ratio(cells: Cells, labels: np.ndarray) -> float | None:
    """Between to within dispersion of the cells' rows; None where it is not defined."""
    counts, sums = label_sums(cells, labels)
    means, middle = sums / counts[:, None], sums.sum(axis=0) / counts.sum()
    around = cells.squares.sum() - (counts * (means**2).sum(axis=1)).sum()
    within = around if around > 1e-12 * cells.squares.sum() else 0.0
    between = (counts * ((means - middle) ** 2).sum(axis=1)).sum()
    k, n = len(counts), counts.sum()
    return float(between * (n - k) / (within * (k - 1))) if k > 1 and within > 0 else None


# merging of labels, on the few centroids of a node; the same rules as the merge operators' own


def gap_threshold(values: np.ndarray, q: int = 20) -> float | None:
    """Right edge of the quantile interval, the last one excepted, with the largest ratio of its edges."""
    if not len(values):
        return None
    edges = np.unique(np.quantile(values, np.arange(q + 1) / q))
    if len(edges) < 3:
        return None

    def rounded(precision: int) -> np.ndarray:
        size = np.abs(edges)
        digits = np.where(size >= 1, precision, -np.floor(np.log10(np.where(size > 0, size, 1))) - 1 + precision)
        return np.where(edges == 0, edges, np.rint(edges * 10.0**digits) / 10.0**digits)

    precision = next((p for p in range(3, 20) if len(np.unique(rounded(p))) == len(edges)), 3)
    right = rounded(precision)
    left = right[:-1].copy()
    left[0] -= 10.0**-precision
    right = right[1:]
    with np.errstate(divide="ignore"):
        ratios = np.where(left == 0, np.inf, right / np.abs(left))[:-1]
    return float(right[int(np.argmax(ratios))])


def _cosine_distances(centers: np.ndarray) -> np.ndarray:
    """NaN for zero vectors and on the diagonal."""
    norms = np.linalg.norm(centers, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        distances = 1.0 - (centers @ centers.T) / (norms[:, None] * norms)
    distances[(norms == 0), :] = np.nan
    distances[:, (norms == 0)] = np.nan
    np.fill_diagonal(distances, np.nan)
    return distances


def _dense(labels: int, groups: list[frozenset]) -> np.ndarray:
    target = np.arange(labels)
    for group in groups:
        target[sorted(group)] = min(group)
    return np.unique(target, return_inverse=True)[1]


def close_mapping(centers: np.ndarray, q: int = 20) -> np.ndarray:
    """New label of each label after merging close centroids by the overlap rule."""
    distances = _cosine_distances(centers)
    threshold = gap_threshold(distances[~np.isnan(distances)], q)
    pairs = [] if threshold is None else np.argwhere(distances <= threshold).tolist()
    return _dense(len(centers), overlapping_groups(map(tuple, pairs)))


def small_mapping(sizes: np.ndarray, centers: np.ndarray, q: int = 20) -> np.ndarray:
    """New label of each label after merging each small one into the nearest large one."""
    threshold = gap_threshold(sizes.astype(float), q)
    pairs = []
    if threshold is not None:
        distances = _cosine_distances(centers)
        distances[:, sizes <= threshold] = np.nan
        for a in np.flatnonzero(sizes <= threshold):
            if not np.isnan(distances[a]).all():
                pairs.append((int(a), int(np.nanargmin(distances[a]))))
    return _dense(len(centers), overlapping_groups(pairs))


# latent features and linear classifiers from sums


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    if not vectors.size:
        return vectors
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(largest < 0, -1.0, 1.0)


@dataclass
class Moments:
    """Sums of a node's rows: ``gram`` of all, counts and sums per label."""

    gram: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    @property
    def rows(self) -> float:
        return float(self.counts.sum())

    @property
    def mean(self) -> np.ndarray:
        return self.sums.sum(axis=0) / self.rows

    def merged(self, mapping: np.ndarray) -> Moments:
        k = int(mapping.max()) + 1
        sums = np.zeros((k, self.sums.shape[1]))
        np.add.at(sums, mapping, self.sums)
        return Moments(self.gram, np.bincount(mapping, self.counts, k), sums)

    def scatter(self) -> tuple[np.ndarray, np.ndarray]:
        """(total, between) covariance."""
        mean, filled = self.mean, self.counts > 0
        total = self.gram / self.rows - np.outer(mean, mean)
        offsets = self.sums[filled] / self.counts[filled, None] - mean
        return total, (offsets * (self.counts[filled, None] / self.rows)).T @ offsets


@dataclass
class Latent:
    """Linear features: ``(x - mean) @ projection``."""

    mean: np.ndarray
    projection: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection


def discriminant_features(moments: Moments, size: int) -> Latent:
    """The directions that best separate the labels, within-label variance 1, then the leading principal
    components of what they leave, variance 1.

    The first are the generalized eigenvectors of the scatter between labels against the one within;
    there are at most as many as labels less one.  Directions without variance are zero.
    """
    total, between = moments.scatter()
    dim = len(total)
    size = min(size, dim)
    within = total - between
    values, vectors = np.linalg.eigh(within + RIDGE * np.diag(np.diag(within)))
    usable = values > max(values[-1], np.trace(total) * 1e-12, 0.0) * 1e-12
    white = vectors[:, usable] / np.sqrt(values[usable])
    gains, own = np.linalg.eigh(white.T @ between @ white)
    kept = np.argsort(-gains, kind="stable")[: min(size, len(moments.counts) - 1)]
    kept = kept[gains[kept] > 1e-9]
    first = white @ own[:, kept]
    basis, _ = np.linalg.qr(first)
    rest = total - basis @ (basis.T @ total)
    rest = rest - (rest @ basis) @ basis.T
    spread, axes = np.linalg.eigh((rest + rest.T) / 2)
    order = np.argsort(-spread, kind="stable")[: size - len(kept)]
    large = spread[order] > max(np.trace(total), 0.0) * 1e-9
    scale = np.where(large, 1 / np.sqrt(np.where(large, spread[order], 1.0)), 0.0)
    return Latent(moments.mean, np.hstack([_signed(first), _signed(axes[:, order]) * scale]))


@dataclass
class Classifier:
    weights: np.ndarray  # features x labels
    offset: np.ndarray

    def scores(self, z: np.ndarray) -> np.ndarray:
        return z @ self.weights + self.offset


def _softmax(scores: np.ndarray) -> np.ndarray:
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def _projected(rows: DataFrame, latents: dict[int, Latent]) -> DataFrame:
    """The rows of the nodes with their latent features, which are fewer numbers than the vectors have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, draws, labels, x in _parts(batch):
                if node in latents:
                    yield _row_batch(np.full(len(x), node), labels, draws, latents[node].of(x))

    return materialize(rows.mapInArrow(work, rows.schema), name="latent")


def fit_classifiers(rows: DataFrame, latents: dict[int, Latent], moments: dict[int, Moments], max_iter: int) -> dict[int, Classifier]:
    """A multinomial logistic classifier per node on its latent features, for the rows' labels.

    It begins as the linear discriminant of the label means; each pass then goes one step up the
    likelihood by a fixed bound on its curvature, so it never falls.  All passes read the latent features,
    which are written once.
    """
    models, inverse = {}, {}
    for node, m in moments.items():
        latent, share = latents[node], np.maximum(m.counts, 1e-9) / m.rows
        means = latent.of(m.sums / np.maximum(m.counts, 1)[:, None])
        models[node] = Classifier(means.T.copy(), np.log(share) - 0.5 * (means**2).sum(axis=1))
        covariance = latent.projection.T @ m.scatter()[0] @ latent.projection
        square = np.zeros((len(covariance) + 1,) * 2)
        square[:-1, :-1], square[-1, -1] = covariance, 1.0  # the features have mean 0
        inverse[node] = np.linalg.inv(0.5 * square + DECAY * np.eye(len(square)))
    if not models or max_iter < 1:
        return models
    rows = _projected(rows, {node: latents[node] for node in models})
    for _ in range(max_iter):

        def slope(node: int, labels: np.ndarray, z: np.ndarray) -> np.ndarray:
            miss = -_softmax(models[node].scores(z))
            miss[np.arange(len(labels)), labels] += 1.0
            return np.vstack([z.T @ miss, miss.sum(axis=0)])

        for node, total in summed(rows, slope).items():
            own = models[node]
            theta = np.vstack([own.weights, own.offset])
            decay = DECAY * theta
            decay[-1] = 0
            theta = theta + inverse[node] @ (total.reshape(theta.shape) / moments[node].rows - decay)
            models[node] = Classifier(theta[:-1], theta[-1])
    discard(rows)
    return models


def label_moments(rows: DataFrame, labels: dict[int, int]) -> dict[int, Moments]:
    """Sums of the rows' vectors by their labels, for nodes with the given number of labels."""

    def statistic(node: int, own: np.ndarray, x: np.ndarray) -> np.ndarray | None:
        if node not in labels:
            return None
        marks = np.zeros((labels[node], len(x)))
        marks[own, np.arange(len(x))] = 1.0
        return np.vstack([x.T @ x, marks @ x, np.broadcast_to(marks.sum(axis=1)[:, None], (labels[node], x.shape[1]))])

    out = {}
    for node, flat in summed(rows, statistic).items():
        k = labels[node]
        dim = int((np.sqrt((2 * k) ** 2 + 4 * len(flat)) - 2 * k) / 2 + 0.5)
        table = flat.reshape(dim + 2 * k, dim)
        out[node] = Moments(table[:dim], table[dim + k :, 0].copy(), table[dim : dim + k])
    return out
