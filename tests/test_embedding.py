"""The neighbour-graph projection against a dense eigenproblem."""

import numpy as np
from pyspark.sql import functions as F

from clarion.operators import embedding as em
from clarion.operators.neighbors import knn


def _rows(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")


def test_eigenvalues_and_residuals(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.6, (70, 2)) for c in ((0, 0), (2, 0), (0, 3))])
    edges = em.neighbour_edges(knn(_rows(spark, x), "id", "v", 6))
    rows, values, residuals = em.eigenvectors(edges, 3)
    s = np.zeros((len(x), len(x)))
    for r in edges.collect():
        s[r.src, r.dst] = r.w
    assert np.allclose(s, s.T)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(s))[::-1][:3], atol=1e-4)
    v = np.zeros((len(x), 3))
    for r in rows.collect():
        v[r.id] = r.x[:3]
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-6) and residuals.max() < em.RESIDUAL
    assert np.linalg.norm(s @ v - v * values, axis=0).max() < 2 * em.RESIDUAL


def test_two_rings_are_separated(spark):
    """One ring inside the other: no line tells them apart, the graph does."""
    a = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    ring = np.stack([np.cos(a), np.sin(a)], axis=1)
    out = em.laplacian_eigenmap(_rows(spark, np.concatenate([ring, 3 * ring])), "id", "v", 2, 4).collect()
    assert len(out) == 240
    first, second = (np.array([r.x for r in out if (r.id < 120) == inner]) for inner in (True, False))
    assert max(np.ptp(first), np.ptp(second)) < 0.5 * abs(first.mean() - second.mean())


def test_neighbours_are_searched_once(spark, monkeypatch):
    from clarion.operators import neighbors

    kept, calls = neighbors.kept, []
    monkeypatch.setattr(em, "kept", lambda df, tag: (calls.append((tag, "MapInArrow" in df._jdf.queryExecution().toString())), kept(df, tag))[1])
    x = np.random.default_rng(2).normal(size=(120, 2))
    assert em.laplacian_eigenmap(_rows(spark, x), "id", "v", 2, 4).count() == 120
    assert [tag for tag, searched in calls if searched] == ["near"]
