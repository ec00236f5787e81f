"""Impurity importance of a random forest (F3) on any number of rows.

* **Bins.**  Features are cut at the quantiles of about ``SAMPLE`` rows, as MLlib
  does, and rows that fall into the same bins with the same label are one cell
  with a count: no tree can tell them apart.
* **Bootstrap.**  A row's weight in a tree is Poisson(1), so a cell's is
  Poisson(count), drawn from a hash of cell and tree: nothing is kept per row and
  tree, and retries and other partitionings draw the same.
* **Levels.**  All trees grow together: one pass over the cells a level, in which
  a task adds up class counts per (tree, node, feature, bin).  The tasks' counts
  meet per tree, where the nodes choose their splits (Gini gain, a random subset of
  the features for each node).  Only the chosen splits come to the driver.

Importance is MLlib's: gain times rows of every split that is left when leaves of
one split with the same class are merged, normalised per tree and over the forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarion.session import kept

BINS, DEPTH, SAMPLE = 32, 5, 10_000
#: Rows that one step of a task holds with their weights.
STEP = 65_536
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _cuts(x: np.ndarray) -> np.ndarray:
    """At most ``BINS`` - 1 places between values, at quantiles."""
    values = np.unique(x)
    if len(values) <= BINS:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1]))


def cells(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(codes, y, n, h): rows (x array, y) with the same bins and label counted, and a hash of both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(cuts))
            codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), b.column("y")], names=["codes", "y"])
    counted = rows.mapInArrow(run, "codes binary, y int").groupBy("codes", "y").agg(F.count(F.lit(1)).alias("n"))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # the passes are all work, the cells few bytes
    return kept(counted.withColumn("h", F.xxhash64("codes", "y")).repartition(tasks, "codes", "y"), "forest-cells")


@lru_cache
def _poisson_cdf(rate: int) -> tuple[int, np.ndarray]:
    """The first value and the distribution function from there on, as far as doubles tell."""
    wide = 12 * sqrt(rate) + 20
    first = max(0, int(rate - wide))
    return first, np.cumsum([np.exp(k * log(rate) - rate - lgamma(k + 1)) for k in range(first, int(rate + wide))])


def poisson(h: np.ndarray, n: np.ndarray, draw: int) -> np.ndarray:
    """Poisson(n) by hash: the sum of Poisson(2 ** k) over the bits of n."""
    out = np.zeros(len(n), np.int64)
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        has = np.flatnonzero(n >> k & 1)
        z = h[has] + np.uint64((draw * 64 + k + 1) * _GOLDEN % 2 ** 64)
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        first, cdf = _poisson_cdf(1 << k)
        out[has] += first + np.searchsorted(cdf, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53, side="right")
    return out


def _counted(feature: np.ndarray, cut: np.ndarray, level: int, classes: int, d: int, bootstrap: bool):
    """Per task and tree the class counts of every node of a level, by feature and bin."""
    trees, nodes = len(feature), 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees, d, nodes * BINS * classes), np.int64)
        for b in batches:
            for s in (b.slice(i, STEP) for i in range(0, b.num_rows, STEP)):
                codes = np.frombuffer(b"".join(s.column("codes").to_pylist()), np.uint8).reshape(-1, d).T.astype(np.int64)
                y, n = (s.column(c).to_numpy().astype(np.int64) for c in ("y", "n"))
                h = s.column("h").to_numpy().view(np.uint64)
                for t in range(trees):
                    w = poisson(h, n, t) if bootstrap else n
                    row = np.flatnonzero(w)
                    at = np.zeros(len(row), np.int64)
                    for _ in range(level):  # down from the root; rows in leaves are done
                        f = feature[t, at]
                        go = f >= 0
                        row, at, f = row[go], at[go], f[go]
                        at = 2 * at + 1 + (codes[f, row] > cut[t, at])
                    base = (at - (nodes - 1)) * (BINS * classes) + y[row]
                    for j in range(d):
                        sums[t, j] += np.bincount(base + codes[j, row] * classes, w[row], nodes * BINS * classes).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array([t.tobytes() for t in sums], pa.binary())], names=["tree", "counts"])
    return run


def _gini(counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    return 1 - ((counts / n) ** 2).sum(axis=-1)


_SPLIT = "tree int, node int, feature int, cut int, gain double, n long, left array<long>, right array<long>"


def _chosen(level: int, classes: int, d: int, few: int, seed: int):
    """The best split of every node of a level, where one gains."""
    nodes = 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, np.ndarray] = {}
        for b in batches:
            for t, counts in zip(b.column("tree").to_pylist(), b.column("counts").to_pylist()):
                trees[t] = trees.get(t, 0) + np.frombuffer(counts, np.int64)
        out = []
        for t, counts in trees.items():
            for i, held in enumerate(counts.reshape(d, nodes, BINS, classes).swapaxes(0, 1)):
                total = held[0].sum(axis=0)
                node, n = nodes - 1 + i, int(total.sum())
                if not n:
                    continue
                tried = np.sort(np.random.default_rng([seed, t, node]).permutation(d)[:few])
                left = held[tried].cumsum(axis=1)[:, :-1]
                right = total - left
                nl, nr = left.sum(axis=-1), right.sum(axis=-1)
                gain = np.where((nl > 0) & (nr > 0), _gini(total) - nl / n * _gini(left) - nr / n * _gini(right), -np.inf)
                f, c = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, c] > 0:
                    out.append((t, node, int(tried[f]), int(c), float(gain[f, c]), n, left[f, c].tolist(), right[f, c].tolist()))
        names = [c.split()[0] for c in _SPLIT.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=names)
    return run


def importances(rows: DataFrame, d: int, trees: int, seed: int) -> np.ndarray:
    """The importance of each of the ``d`` features of rows (x array<double>, y int from 0 on)."""
    n, most = rows.agg(F.count(F.lit(1)), F.max("y")).first()
    if not n:
        raise ValueError("a forest needs rows")
    classes = int(most) + 1
    sample = np.array([r[0] for r in rows.select("x").sample(min(1.0, SAMPLE / n), seed).collect()]).reshape(-1, d)
    table = cells(rows, [_cuts(sample[:, j]) for j in range(d)])
    few = d if trees == 1 else ceil(sqrt(d))
    feature, cut = np.full((trees, 2 ** DEPTH - 1), -1), np.zeros((trees, 2 ** DEPTH - 1), np.int64)
    splits = {}
    for level in range(DEPTH):
        counts = table.mapInArrow(_counted(feature, cut, level, classes, d, trees > 1), "tree int, counts binary")
        found = counts.repartition("tree").mapInArrow(_chosen(level, classes, d, few, seed), _SPLIT).collect()  # nodes of a bounded forest
        if not found:
            break
        for s in found:
            feature[s["tree"], s["node"]], cut[s["tree"], s["node"]] = s["feature"], s["cut"]
            splits[s["tree"], s["node"]] = s
    share = np.zeros((trees, d))
    leaf_class: dict[tuple[int, int], int] = {}  # of splits that are merged
    for (t, node), s in sorted(splits.items(), key=lambda kv: -kv[0][1]):
        ends = [leaf_class.get((t, 2 * node + 1 + k)) if (t, 2 * node + 1 + k) in splits else int(np.argmax(s[side])) for k, side in enumerate(("left", "right"))]
        if ends[0] is not None and ends[0] == ends[1]:
            leaf_class[t, node] = ends[0]
        else:
            share[t, s["feature"]] += s["gain"] * s["n"]
    share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    return share.sum(axis=0) / max(share.sum(), 1e-300)
