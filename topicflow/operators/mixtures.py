"""Gaussian mixtures with diagonal covariances, one per node of a level, by expectation maximization.

Each round is one pass: the rows' posteriors are added up as weights, sums and squares per component of
every node.  Variances are floored at a share of the node's own, so copies of one row and components
of one row stay defined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .node_fits import cut_merges, fit_cells, label_sums, summed, ward_merges

FLOOR = 1e-3


@dataclass
class Mixture:
    shares: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    floor: np.ndarray
    likelihoods: list[float]

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log density of each row in each component, times its share."""
        precision = 1 / self.variances
        square = (x**2) @ precision.T - 2 * x @ (self.means * precision).T + (self.means**2 * precision).sum(axis=1)
        with np.errstate(divide="ignore"):
            own = np.log(self.shares)
        return own - 0.5 * (square + np.log(2 * np.pi * self.variances).sum(axis=1))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        logs = self.logs(x)
        weights = np.exp(logs - logs.max(axis=1, keepdims=True))
        return weights / weights.sum(axis=1, keepdims=True)

    def labels(self, x: np.ndarray) -> np.ndarray:
        return self.logs(x).argmax(axis=1).astype(np.int32)

    def statistics(self, x: np.ndarray) -> np.ndarray:
        """Per component: weight, sums, squares; the log likelihood beside the first weight."""
        logs = self.logs(x)
        most = logs.max(axis=1, keepdims=True)
        weights = np.exp(logs - most)
        total = weights.sum(axis=1, keepdims=True)
        weights /= total
        out = np.zeros((len(self.shares), 2 + 2 * x.shape[1]))
        out[:, 0] = weights.sum(axis=0)
        out[0, 1] = (most + np.log(total)).sum()
        out[:, 2 : 2 + x.shape[1]] = weights.T @ x
        out[:, 2 + x.shape[1] :] = weights.T @ (x**2)
        return out

    def updated(self, flat: np.ndarray) -> Mixture:
        dim = self.means.shape[1]
        table = flat.reshape(-1, 2 + 2 * dim)
        weights = table[:, :1]
        used = np.maximum(weights, 1e-12)
        means = np.where(weights > 1e-9, table[:, 2 : 2 + dim] / used, self.means)
        squares = table[:, 2 + dim :] / used - means**2
        variances = np.where(weights > 1e-9, np.maximum(squares, self.floor), self.variances)
        return Mixture(weights[:, 0] / weights.sum(), means, variances, self.floor, [*self.likelihoods, float(table[0, 1])])


def fit_mixtures(rows: DataFrame, k: int, max_iter: int = 30, tolerance: float = 1e-6) -> dict[int, Mixture]:
    """A mixture of ``k`` components for each node of ``rows`` (see ``node_rows``).

    The components begin at the clusters of a Ward linkage of cells; nodes with fewer different rows than
    ``k`` have components without a share.  Rounds end when no node's mean log likelihood rises by more
    than ``tolerance``.
    """
    counts = dict(rows.groupBy("node").agg(F.count("*")).collect())
    models: dict[int, Mixture] = {}
    for node, cells in fit_cells(rows, counts, k).items():
        sizes, sums = label_sums(cells, cut_merges(len(cells.counts), ward_merges(cells.counts, cells.means), k))
        total, mean = sizes.sum(), sums.sum(axis=0) / sizes.sum()
        spread = max(cells.squares.sum() / total - (mean**2).sum(), 0.0) / len(mean)
        floor = np.full(len(mean), max(FLOOR * spread, 1e-12 * max(1.0, (mean**2).max())))
        means, shares = np.tile(mean, (k, 1)), np.zeros(k)
        means[: len(sizes)], shares[: len(sizes)] = sums / sizes[:, None], sizes / total
        models[node] = Mixture(shares, means, np.maximum(np.full(means.shape, spread), floor), floor, [])
    moving = set(models)
    for _ in range(max_iter):
        if not moving:
            break
        now = {n: models[n] for n in moving}
        for node, flat in summed(rows, lambda node, _, x: now[node].statistics(x) if node in now else None).items():
            models[node] = models[node].updated(flat)
            gains = models[node].likelihoods
            if len(gains) > 1 and (gains[-1] - gains[-2]) / counts[node] <= tolerance:
                moving.discard(node)
    return models
