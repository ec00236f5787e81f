"""Feature selection, reduction and keyed assembly."""

import numpy as np
import pytest

from clarion.operators import features as fe
from clarion.operators import quality as qa


def _frame(spark, n=200):
    rng = np.random.default_rng(0)
    a, c = rng.normal(size=n), rng.normal(size=n)
    x = np.stack([a, 2 * a + 1e-3 * rng.normal(size=n), c, rng.normal(size=n)], axis=1)
    y = (a + 0.2 * c > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label int"), x


def test_select_features_prunes_then_ranks(spark):
    df, _ = _frame(spark)
    assert fe.select_features(df, ["a", "b", "c", "d"]) == ["a", "c", "d"]
    assert fe.select_features(df, ["a", "b", "c", "d"], top_k=2) == ["a", "c"]


def test_pca_reduce_keeps_the_variance_and_the_ids(spark):
    df, x = _frame(spark)
    out = {r.id: r.pca for r in fe.pca_reduce(df, ["a", "b", "c", "d"], k=50, id_cols=["id"]).collect()}
    assert len(out) == len(x) and all(len(v) == 4 for v in out.values())
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = np.array([out[i] for i in range(len(x))])
    assert np.allclose(np.sort(got.var(axis=0)), np.sort(np.linalg.eigvalsh(np.cov(z.T, bias=True))), atol=1e-6)


def test_assemble_by_key_is_not_by_position(spark):
    left = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "id int, x string")
    right = spark.createDataFrame([(1, 10), (3, 30), (4, 40)], "id int, y int")
    assert sorted(map(tuple, fe.assemble_by_key(left, right, "id").collect())) == [(1, "a", 10), (3, "c", 30)]


def test_correlation_takes_each_pairs_own_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1.0, (300, 3))
    x[:, 1] += x[:, 0]
    holes = rng.random((300, 3)) < 0.3
    rows = [tuple(None if h and i % 2 else float("nan") if h else float(v) for v, h in zip(r, hs)) + (5.0, None) for i, (r, hs) in enumerate(zip(x, holes))]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, none double")
    got = {(r.col_i, r.col_j): r.r for r in qa.correlation_long(df, df.columns).collect()}
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            if i < j:
                both = ~holes[:, i] & ~holes[:, j]
                assert got[p, q] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert got["a", "flat"] is None and got["a", "none"] is None and len(got) == 10


def test_importance_does_not_depend_on_partitions(spark):
    """Weights are drawn by content: the forest was fitted from weights that were held for each row and tree of a partition."""
    df, _ = _frame(spark, 600)
    cols = ["a", "b", "c", "d"]
    one, many = ([tuple(r) for r in fe.importance_ranking(df.repartition(n, "id"), cols, num_trees=20).orderBy("rank").collect()] for n in (1, 7))
    assert one == many and {one[0][0], one[1][0]} == {"a", "b"}
    assert sum(r[1] for r in one) == pytest.approx(1.0)


def test_importance_is_near_that_of_mllib(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    df, _ = _frame(spark, 600)
    cols = ["a", "c", "d"]
    mine = {r.feature: r.importance for r in fe.importance_ranking(df, cols, num_trees=60).collect()}
    model = RandomForestClassifier(featuresCol="f", labelCol="label", numTrees=60, seed=1).fit(VectorAssembler(inputCols=cols, outputCol="f").transform(df))
    assert [mine[c] for c in cols] == pytest.approx(model.featureImportances.toArray().tolist(), abs=0.05)


def test_weights_of_a_cell_are_poisson():
    from clarion.operators.forest import poisson
    n = np.repeat([1, 6, 1000], 20_000)
    w = poisson(np.random.default_rng(0).integers(0, 2 ** 63, len(n)).astype(np.uint64), n, 3)
    for k in (1, 6, 1000):
        assert w[n == k].mean() == pytest.approx(k, rel=0.03) and w[n == k].var() == pytest.approx(k, rel=0.06)


def test_importance_refuses_missing_values(spark):
    df = spark.createDataFrame([(1.0, None, 0), (2.0, 1.0, 1)], "a double, b double, label int")
    with pytest.raises(Exception, match="(?i)null"):
        fe.importance_ranking(df, ["a", "b"], num_trees=2).collect()


def test_columns_that_do_not_vary_have_no_correlation_in_any_partitioning(spark):
    """Counts, means and moments of many tasks are merged; 0.1 added up is not 0.1 times the count."""
    rows = [(0.1, 1e9 + i % 7, float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "flat double, far double, i double")
    for n in (1, 7):
        got = {(r.col_i, r.col_j): r.r for r in qa.correlation_long(df.repartition(n), df.columns).collect()}
        assert got["flat", "far"] is None and got["flat", "i"] is None
        assert got["far", "i"] == pytest.approx(np.corrcoef([r[1] - 1e9 for r in rows], [r[2] for r in rows])[0, 1], abs=1e-9)
