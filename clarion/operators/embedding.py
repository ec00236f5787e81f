"""Non-linear projection of points by their neighbour graph (C6): Laplacian eigenmap.

The k nearest neighbours of every point make a graph; the eigenvectors of its
normalised adjacency S = D^-1/2 W D^-1/2 with the largest eigenvalues, scaled by
D^-1/2, are coordinates in which neighbours lie together.  S is an edge table
and is only ever multiplied with a few columns: a join on one end and a sum by
the other.  One round multiplies ``STEPS`` times, gathers all the products of a
point in its row, sends their Gram matrix (a few dozen rows and columns,
whatever the data) to the driver and replaces the columns by the best
combinations there (Rayleigh-Ritz).  Rounds end when the residuals
|S x - theta x| are small.  Every round is written, so a lost executor costs its
tasks only.

Ids are unique.  Signs of coordinates are arbitrary.  A graph of several
components has as many eigenvalues of 1, and their coordinates tell the
components apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarion.operators.neighbors import knn
from clarion.session import kept

NEIGHBOURS, STEPS, MORE_COLUMNS, MOST_ROUNDS, RESIDUAL, SEED = 10, 6, 4, 12, 1e-3, 42


def neighbour_edges(near: DataFrame) -> DataFrame:
    """(src, dst, w) of S from (id, nid), both directions, and (id, id, 0) for every point."""
    both = near.select(F.col("id").alias("src"), F.col("nid").alias("dst")).unionByName(near.select(F.col("nid").alias("src"), F.col("id").alias("dst"))).distinct()
    degree = kept(both.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "degrees")
    edges = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
    own = degree.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("w"))
    return kept(edges.select("src", "dst", (1 / F.sqrt(F.col("n").cast("double") * F.col("m"))).alias("w")).unionByName(own), "edges")


def _multiplied(edges: DataFrame, rows: DataFrame, columns: int) -> DataFrame:
    """(id, x): every point's products so far, and S times the last ``columns`` of them behind."""
    last = F.slice("x", F.size("x") - columns + 1, columns)
    met = edges.join(rows, F.col("dst") == F.col("id")).select("src", "w", F.when(F.col("src") == F.col("dst"), F.col("x")).alias("own"), last.alias("last"))
    held = met.groupBy("src").agg(F.first("own", ignorenulls=True).alias("own"), F.array(*[F.sum(F.col("w") * F.col("last")[i]) for i in range(columns)]).alias("new"))
    return held.select(F.col("src").alias("id"), F.concat("own", "new").alias("x"))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """The matrix of all products of two columns, added up over the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width))
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, width)
            sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(sums.ravel())], names=["at", "sum"])
    out = np.zeros(width * width)
    for r in rows.select("x").mapInArrow(run, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
        out[r["at"]] = r["sum"]
    return out.reshape(width, width)


def _best(gram: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combinations of all but the last products that are nearest to eigenvectors: (weights, eigenvalues, residuals)."""
    n = len(gram) - columns
    size, turn = np.linalg.eigh(gram[:n, :n])
    good = size > 1e-10 * size.max()
    plain = turn[:, good] / np.sqrt(size[good])
    inner = plain.T @ gram[:n, columns:] @ plain
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    top = np.argsort(-value)[:columns]
    weights = plain @ vector[:, top]
    rest = np.vstack([np.zeros((columns, weights.shape[1])), weights])  # S times the combinations, less theirs
    rest[:n] -= weights * value[top]
    return weights, value[top], np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", rest, gram, rest), 0))


def eigenvectors(edges: DataFrame, wanted: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, x) with the ``wanted`` first eigenvectors of S, their eigenvalues and residuals."""
    columns = wanted + MORE_COLUMNS
    draw = lambda j: F.xxhash64(F.lit(SEED), F.lit(j), F.col("id").cast("string")) / float(2 ** 63)
    rows = kept(edges.where("src = dst").select(F.col("src").alias("id")).withColumn("x", F.array(*[draw(j) for j in range(columns)])), "columns")
    for _ in range(MOST_ROUNDS):
        for _ in range(STEPS):
            rows = _multiplied(edges, rows, columns)
        rows = kept(rows, "products")
        weights, values, residuals = _best(_gram(rows, columns * (STEPS + 1)), columns)
        held = weights.shape[1]
        combined = [F.aggregate(F.zip_with(F.slice("x", 1, len(weights)), F.array(*[F.lit(float(w)) for w in weights[:, j]]), lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b) for j in range(held)]
        rows = kept(rows.select("id", F.array(*combined).alias("x")), "columns")
        columns = held
        if residuals[:wanted].max() < RESIDUAL:
            break
    return rows, values[:wanted], residuals[:wanted]


def laplacian_eigenmap(df: DataFrame, id_col: str, vec_col: str, dims: int = 2, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, x, y[, z]): the eigenvectors behind the first, per square root of the degree."""
    edges = neighbour_edges(kept(knn(df, id_col, vec_col, neighbours).select("id", "nid"), "near"))  # searched once
    rows, _, _ = eigenvectors(edges, dims + 1)
    degree = edges.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(degree, "id").select("id", *[(F.col("x")[j + 1] / F.sqrt("n")).alias(name) for j, name in zip(range(dims), "xyz")])
