"""The model search: shared fits, candidates, ensembles, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clarion.operators import learners
from clarion.operators import models as mo
from clarion.operators import search as se


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    return x, (x[:, 0] * x[:, 1] + x[:, 2] + 0.3 * rng.normal(size=n) > 0.4).astype(float)


def frame(spark, n=400):
    x, y = data(n)
    return spark.createDataFrame([(f"r{i}", row.tolist(), int(t), i % 5) for i, (row, t) in enumerate(zip(x, y))], "id string, v array<double>, label int, fold int")


def test_prefixes_equal_separate_fits():
    x, y = data()
    for name, lengths, rest in (("random_forest", [20, 40, 60], {"max_depth": None, "min_samples_leaf": 2}), ("gradient_boosting", [15, 30], {"max_depth": 3, "learning_rate": 0.1, "subsample": 0.8})):
        together = se.fit(name, [{"n_estimators": n, **rest} for n in lengths], x, y)
        for n, model in zip(lengths, together):
            alone, = se.fit(name, [{"n_estimators": n, **rest}], x, y)
            assert np.array_equal(learners.predict(model, x), learners.predict(alone, x))
    path = se.fit("logistic_regression", [{"C": c} for c in (100, 0.01, 1)], x, y)
    for c, model in zip((100, 0.01, 1), path):
        alone, = se.fit("logistic_regression", [{"C": c}], x, y)
        assert np.allclose(model["w"], alone["w"], atol=1e-6)


def test_learners_learn_what_they_can():
    x, y = data(1_500)
    new, truth = data(1_500, 1)
    for name, params, least in (("logistic_regression", {"C": 1}, 0.8), ("random_forest", {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1}, 0.88), ("svm", {"C": 10, "gamma": "scale"}, 0.88),
                                ("gradient_boosting", {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.8}, 0.88),
                                ("mlp", {"hidden_layer_sizes": [64, 32], "alpha": 0.001, "learning_rate_init": 0.01}, 0.88)):
        p = learners.predict(se.fit(name, [params], x, y)[0], new)
        assert ((p > 0.5) == truth).mean() > least, name


def test_trees_split_where_the_gain_is():
    """One tree of one split equals a search over all cuts."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = (x[:, 1] > 4).astype(float)
    codes = learners.codes_of(x, np.tile(np.arange(8.0), (3, 1)))
    feature, cut, left, value = learners.grow(codes, -y[None], np.ones((1, 200)), 1, 1, 0.0)
    assert (feature[0], cut[0], left[0]) == (1, 4, 1) and value[1:].tolist() == [0.0, 1.0] and feature[1:].tolist() == [-1, -1]


def test_candidates_are_the_whole_grids():
    counts = {name: len(mo.param_candidates(name)) for name in mo.GRIDS}
    assert counts == {"logistic_regression": 5, "random_forest": 25, "gradient_boosting": 25, "svm": 8, "mlp": 18}
    fits = se.shared_fits({name: mo.param_candidates(name) for name in mo.GRIDS})
    served = [(name, i) for name, places in fits for i in places]
    assert sorted(served) == sorted((name, i) for name, n in counts.items() for i in range(n))
    assert sum(name == "logistic_regression" for name, _ in fits) == 1 and sum(name == "svm" for name, _ in fits) == 4


GRIDS = {"logistic_regression": [{"C": 0.1}, {"C": 10}], "svm": [{"C": 1, "gamma": "scale"}, {"C": 1, "gamma": "auto"}],
         "random_forest": [{"n_estimators": 20, "max_depth": 3, "min_samples_leaf": 1}, {"n_estimators": 40, "max_depth": 3, "min_samples_leaf": 1}],
         "gradient_boosting": [{"n_estimators": 20, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0}],
         "mlp": [{"hidden_layer_sizes": [8], "alpha": 0.001, "learning_rate_init": 0.01}]}


@pytest.fixture(scope="module")
def found(spark):
    return se.search(frame(spark), "id", "v", "label", "fold", GRIDS)


def test_mean_and_std_of_every_candidate(spark, found):
    rows = found["candidates"].collect()
    assert len(rows) == 8 and all(0 <= r.mean_recall <= 1 and r.std_recall >= 0 for r in rows)
    x, y, folds, _ = se.training_rows(frame(spark), "id", "v", "label", "fold")
    for i, c in enumerate((0.1, 10)):
        each = []
        for f in range(5):
            model, = se.fit("logistic_regression", [{"C": c}], x[folds != f], y[folds != f])
            each.append(se.recall(y[folds == f], learners.predict(model, x[folds == f])))
        r, = [r for r in rows if r.model == "logistic_regression" and r.candidate == i]
        assert abs(r.mean_recall - np.mean(each)) < 1e-9 and abs(r.std_recall - np.std(each)) < 1e-9


def test_ensembles_are_columns_of_the_scored_rows(spark, found):
    assert len(found["top"]) == 3 and len(found["meta"]) == 4
    df = frame(spark, 50)
    out = se.scores(df, "v", found["models"])
    rows = out.select("v", "p", se.voting(found["top"]).alias("vote"), se.stacking(found["top"], found["meta"]).alias("stack")).collect()
    for r in rows:
        p = [learners.predict(found["models"][n], np.array([r.v]))[0] for n in found["top"]]
        assert abs(r.vote - np.mean(p)) < 1e-12
        assert abs(r.stack - learners.sigmoid(np.dot(p, found["meta"][:-1]) + found["meta"][-1])) < 1e-12
    assert "Join" not in out._jdf.queryExecution().toString()


def test_saved_models_give_the_same_scores(spark, found, tmp_path):
    path = f"file://{tmp_path}/models"
    se.save_models(found["fits"], path)
    again = se.load_models(spark, path)
    assert set(again) == set(GRIDS)
    df = frame(spark, 60)
    one, two = (se.scores(df, "v", m).select("id", "p.*").orderBy("id").collect() for m in (found["models"], again))
    assert one == two


def test_training_rows_are_bounded_and_stable(spark):
    df = frame(spark)
    a = se.training_rows(df, "id", "v", "label", "fold", 50)
    b = se.training_rows(df.repartition(7, F.rand()), "id", "v", "label", "fold", 50)
    assert len(a[3]) == 50 and a[3] == b[3] and np.array_equal(a[0], b[0])
