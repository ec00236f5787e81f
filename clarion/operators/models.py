"""Models on all rows with MLlib (M1-M3, M11) and the search spaces (M6).

Every estimator reads a vector column ``features`` and a double ``label``.  The
search over all five models, its ensembles and their scores are in ``search``.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Search spaces of the reference configuration (fixed values).
GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1, 10, 100]},
    "random_forest": {"n_estimators": [200, 400, 600], "max_depth": [None, 6, 10, 16], "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting": {"n_estimators": [200, 400], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1],
                          "subsample": [0.8, 1.0]},
    "svm": {"C": [0.1, 1, 10, 100], "gamma": ["scale", "auto"]},
    "mlp": {"hidden_layer_sizes": [[64], [64, 32], [128, 64, 32]], "alpha": [0.0001, 0.001, 0.01], "learning_rate_init": [0.001, 0.01]},
}
RANDOM_DRAWS = 25          # random search draws for the tree models
FOLDS = 5
SEED = 42
MAX_DEPTH_NONE = 30        # MLlib's depth cap stands for "no limit"
TOP_N_ENSEMBLE = 3


def make_estimator(name: str, params: dict, n_rows: int, n_features: int, seed: int = SEED,
                   features: str = "features", label: str = "label", weight_col: str | None = None):
    """One estimator (or pipeline) per reference model name; sklearn-style
    parameters are mapped to their MLlib counterparts."""
    if name == "logistic_regression":
        c = float(params.get("C", 1.0))
        kw = dict(featuresCol=features, labelCol=label, maxIter=int(params.get("max_iter", 2000)), elasticNetParam=0.0,
                  regParam=1.0 / (c * max(n_rows, 1)), standardization=False)
        if weight_col:
            kw["weightCol"] = weight_col
        return LogisticRegression(**kw)
    if name == "random_forest":
        depth = params.get("max_depth")
        kw = dict(featuresCol=features, labelCol=label, numTrees=int(params.get("n_estimators", 300)),
                  maxDepth=MAX_DEPTH_NONE if depth is None else int(depth),
                  minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=seed)
        if weight_col:
            kw["weightCol"] = weight_col
        return RandomForestClassifier(**kw)
    if name == "gradient_boosting":
        return GBTClassifier(featuresCol=features, labelCol=label, maxIter=int(params.get("n_estimators", 100)),
                             maxDepth=int(params.get("max_depth", 3)), stepSize=float(params.get("learning_rate", 0.1)),
                             subsamplingRate=float(params.get("subsample", 1.0)), seed=seed)
    raise ValueError(f"unknown model: {name}")


def param_candidates(name: str, draws: int = RANDOM_DRAWS, seed: int = SEED) -> list[dict]:
    """Full grid for logistic / svm / mlp, a seeded random subset of the grid
    (``draws`` points) for the tree models."""
    grid = GRIDS[name]
    keys = list(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if name in ("random_forest", "gradient_boosting") and len(combos) > draws:
        rng = random.Random(seed)
        combos = rng.sample(combos, draws)
    return combos


def assemble(df: DataFrame, feature_cols: Sequence[str], label: str = "label",
             extra: Sequence[str] = ()) -> DataFrame:
    va = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
    return va.transform(df).select(*extra, "features", F.col(label).cast("double").alias("label"))


def positive_probability(model, df: DataFrame, out_col: str, prob_col: str = "probability") -> DataFrame:
    return model.transform(df).withColumn(out_col, vector_to_array(prob_col)[1])


def fallback_model(data: DataFrame, seed: int = SEED) -> PipelineModel:
    """300-tree random forest with balanced class weights."""
    from clarion.operators.features import with_class_weights
    w = with_class_weights(data, "label", "weight")
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=300, seed=seed, weightCol="weight")
    return PipelineModel(stages=[rf.fit(w)])


def vector_column(df: DataFrame, array_col: str, out_col: str = "features") -> DataFrame:
    return df.withColumn(out_col, array_to_vector(array_col))
