"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quantiles, stored


@dataclass
class Trees:
    """Complete trees of one depth as arrays: node k of a tree has the children 2k+1 and 2k+2; leaves come last.

    ``feature`` and ``threshold`` are [trees, 2**depth - 1]; a row goes right where its value is above the threshold
    (NaN counts as not above).  ``leaf`` is [trees, 2**depth].  The score is the sigmoid of base plus the leaves.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


ONE = 1 << 30  # gradients are summed in whole multiples of 1 / ONE, so that no sum depends on how rows lie
CHUNK = 1 << 16  # rows summed at once
_NEVER = 255  # a bin above all others

Sums = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
              bins: int = 32, ridge: float = 5.0) -> Trees:
    """Fit labels in [0, 1] to rows in memory.  ``monotone`` has -1, 0 or 1 per feature: how the score may move as the feature grows."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(y) else []
    coded = _coded(x, edges) if len(y) else None
    kinds = (len(y), float(y.mean()), float(y.min()), float(y.max())) if len(y) else (0, 0.0, 0.0, 0.0)
    sums = lambda of: sum(of(coded[a:a + CHUNK], y[a:a + CHUNK]) for a in range(0, len(y), CHUNK))
    return _boosted(sums, kinds, edges, monotone, trees, depth, rate, ridge)


def fit_table(rows: DataFrame, features: list[str], label: str, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
              bins: int = 32, ridge: float = 5.0) -> Trees:
    """The same trees for the rows of a table, however many: bins from exact quantiles, one pass over the bins' numbers for each level of each tree."""
    shares = np.linspace(0, 1, bins + 1)[1:-1].tolist()
    n, mean, low, high = rows.agg(F.count("*"), F.avg(label), F.min(label), F.max(label)).first()
    if not n or low == high:
        return _boosted(None, (n, mean or 0.0, low or 0.0, high or 0.0), [], monotone, trees, depth, rate, ridge)
    each = rows.select(F.posexplode(F.array(*(F.col(f).cast("double") for f in features))).alias("key", "value"), F.lit(1).alias("times"))
    found = quantiles(each, shares)
    edges = [np.unique(found[f]) for f in range(len(features))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.asarray(batch.column(f)) for f in range(len(features))], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in (_coded(x, edges).tobytes(), np.asarray(batch.column(len(features))).tobytes())],
                                                 names=["coded", "labels"])

    # small beside the texts: a byte for each feature of a labelled row
    packed = stored(rows.select(*(F.col(f).cast("double") for f in features), F.col(label).cast("double")).mapInArrow(code, "coded binary, labels binary"), "boosting-rows")
    chunks = packed.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def sums(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def part(held: Iterator[tuple[bytes, bytes]]) -> Iterator[np.ndarray]:
            total = 0
            for coded, labels in held:
                total = total + of(np.frombuffer(coded, np.uint8).reshape(-1, len(features)), np.frombuffer(labels, np.float64))
            return iter([total] if isinstance(total, np.ndarray) else [])
        return chunks.mapPartitions(part).reduce(np.add)

    try:
        return _boosted(sums, (n, mean, low, high), edges, monotone, trees, depth, rate, ridge)
    finally:
        chunks.unpersist()


def _coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)


def _leaves_of(coded: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row below that many levels of a tree, counted from the left."""
    node, rows = np.zeros(len(coded), np.int64), np.arange(len(coded))
    for _ in range(levels):
        node = 2 * node + 1 + (coded[rows, feature[node]] > cut[node])
    return node - (2 ** levels - 1)


def _boosted(sums: Sums, kinds: tuple[int, float, float, float], edges: list[np.ndarray], monotone: np.ndarray, trees: int, depth: int, rate: float, ridge: float) -> Trees:
    """Trees from sums over all rows: ``sums`` adds up what a function makes of each piece of the rows, as bin numbers and labels.

    A split on a constrained feature is taken only if its two leaf values are in order, and the middle between them
    bounds all leaves below, so the constraint holds for the whole sum.  No rows, or labels of one kind, give a constant.
    """
    inner, (n, mean, least, most) = 2 ** depth - 1, kinds
    mean = float(np.clip(mean if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    if n == 0 or least == most:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    width = max(map(len, edges)) + 1
    feature, cuts, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), _NEVER), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        bounds, values = {0: (-np.inf, np.inf)}, {}
        for level in range(depth):
            def histogram(coded: np.ndarray, y: np.ndarray, t=t, level=level) -> np.ndarray:
                """Gradients and curvatures by node of the level, feature and bin."""
                raw = np.full(len(y), base)
                for k in range(t):
                    raw += leaf[k, _leaves_of(coded, feature[k], cuts[k], depth)]
                p = 1 / (1 + np.exp(-raw))
                both = np.rint(np.stack([p - y, np.maximum(p * (1 - p), 1e-6)]) * ONE)
                place = _leaves_of(coded, feature[t], cuts[t], level) * width
                size = width * 2 ** level
                return np.array([[np.bincount(place + c, w, size) for c in coded.T] for w in both]).astype(np.int64)

            g, h = (sums(histogram) / ONE).reshape(2, len(edges), 2 ** level, width)
            for k in range(2 ** level):
                node = 2 ** level - 1 + k
                low, high = bounds.pop(node)
                found = _best_split(g[:, k], h[:, k], edges, monotone, low, high, ridge)
                left_bounds = right_bounds = (low, high)
                left, right = (g[0, k].sum(), h[0, k].sum()), (0.0, 0.0)
                if found:
                    f, cut, a, b = found
                    feature[t, node], cuts[t, node], threshold[t, node] = f, cut, edges[f][cut]
                    left, right = ((g[f, k, i].sum(), h[f, k, i].sum()) for i in (slice(cut + 1), slice(cut + 1, None)))
                    middle = (a + b) / 2
                    if monotone[f] > 0:
                        left_bounds, right_bounds = (low, middle), (middle, high)
                    elif monotone[f] < 0:
                        left_bounds, right_bounds = (middle, high), (low, middle)
                bounds[2 * node + 1], bounds[2 * node + 2] = left_bounds, right_bounds
                values[2 * node + 1], values[2 * node + 2] = left, right
        for node in range(inner, 2 * inner + 1):
            g_sum, h_sum = values[node]
            leaf[t, node - inner] = rate * np.clip(-g_sum / (h_sum + ridge), *bounds[node])
    return Trees(base, feature, threshold, leaf)


def _best_split(g, h, edges, monotone, low, high, ridge):
    """Feature, bin and both values of the split with the greatest gain, or None; ``g`` and ``h`` hold sums by feature and bin."""
    best, choice = 1e-6, None
    total_g, total_h = g[0].sum(), h[0].sum()
    whole = total_g ** 2 / (total_h + ridge)
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        left_g, left_h = g[f, :len(edge) + 1].cumsum()[:-1], h[f, :len(edge) + 1].cumsum()[:-1]
        a, b = (np.clip(-u / (v + ridge), low, high) for u, v in ((left_g, left_h), (total_g - left_g, total_h - left_h)))
        gain = left_g ** 2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - whole
        if monotone[f]:
            gain = np.where(monotone[f] * (b - a) >= 0, gain, -np.inf)
        k = int(gain.argmax())
        if gain[k] > best:
            best, choice = gain[k], (f, k, a[k], b[k])
    return choice
