"""Model search, ensembles and their scores as Spark jobs (M6-M9).

The training rows of a search are bounded: the first ``SEARCH_ROWS`` by content
hash (all of them where there are fewer).  Every task holds them; what the
cluster shares out is the fits, one row of a table each, so a lost executor
costs its fits and nothing else.  Candidates that differ only in what one fit
already contains share it: lengths of forests and boosted models (prefixes),
the penalties of logistic regression (one path), an SVM's gamma of ``scale`` and
``auto`` (equal on standardised features).

Scoring has no bound: rows meet all models in one pass, so ensembles need no
join.  Fitted models are rows too (name, parameters, arrays) and are saved and
read as Parquet at any path that Spark knows.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clarion.operators import learners
from clarion.operators.models import FOLDS, GRIDS, SEED, TOP_N_ENSEMBLE, param_candidates
from clarion.session import kept

#: The most labelled rows that a search or a final fit learns from.
SEARCH_ROWS = 20_000
#: Parameters whose candidates one fit serves.
SHARED = {"random_forest": "n_estimators", "gradient_boosting": "n_estimators", "logistic_regression": "C", "svm": "gamma"}


def training_rows(df: DataFrame, id_col: str, vec_col: str, label: str, fold: str, rows: int = SEARCH_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Features, labels, folds and ids of the bounded training rows, in order of their content hash."""
    picked = df.select(F.col(id_col).cast("string").alias("id"), vec_col, F.col(label).cast("double").alias("y"), fold).orderBy(
        F.md5(F.concat(F.lit(f"{SEED}|search|"), "id")), "id").limit(rows).collect()
    return (np.array([r[1] for r in picked], float), np.array([r[2] for r in picked], float), np.array([r[3] for r in picked], int), [r[0] for r in picked])


def fit(name: str, wanted: list[dict], x: np.ndarray, y: np.ndarray, seed: int = SEED) -> list[dict]:
    """The models of candidates that share a fit, in their order."""
    one = {k: v for k, v in wanted[0].items() if k != SHARED.get(name)}
    if name == "logistic_regression":
        made = learners.fit_logistic(x, y, [p["C"] for p in wanted])
        return [made[p["C"]] for p in wanted]
    if name == "random_forest":
        made = learners.fit_forest(x, y, [p["n_estimators"] for p in wanted], seed=seed, **one)
        return [made[p["n_estimators"]] for p in wanted]
    if name == "gradient_boosting":
        made = learners.fit_boosted(x, y, [p["n_estimators"] for p in wanted], seed=seed, **one)
        return [made[p["n_estimators"]] for p in wanted]
    if name == "svm":
        return [learners.fit_svm(x, y, one["C"], seed=seed)] * len(wanted)
    if name == "mlp":
        return [learners.fit_mlp(x, y, seed=seed, **p) for p in wanted]
    raise ValueError(f"unknown model: {name}")


def shared_fits(grids: dict[str, list[dict]]) -> list[tuple[str, list[int]]]:
    """(model, places of the candidates that one fit serves)."""
    out = []
    for name, candidates in grids.items():
        groups: dict[str, list[int]] = {}
        for i, p in enumerate(candidates):
            groups.setdefault(json.dumps({k: v for k, v in p.items() if k != SHARED.get(name)}, sort_keys=True), []).append(i)
        out += [(name, places) for places in groups.values()]
    return out


def recall(y: np.ndarray, p: np.ndarray) -> float:
    """Recall of class 1 at one half; 0 without positives."""
    return float(((p > 0.5) & (y == 1)).sum() / max(1, (y == 1).sum()))


def _spread(spark: SparkSession, jobs: list[tuple], schema: str) -> DataFrame:
    """One partition per job, in an order that mixes long and short ones."""
    return spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], f"job int, {schema}").repartition(max(1, len(jobs)), "job")


def cross_validated(spark: SparkSession, grids: dict[str, list[dict]], x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> DataFrame:
    """M6: (model, candidate, params, fold, recall) for every candidate and fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, places, fold in zip(b.column("model").to_pylist(), b.column("places").to_pylist(), b.column("fold").to_pylist()):
                own = folds != fold
                models = fit(name, [grids[name][i] for i in places], x[own], y[own])
                scores = [recall(y[~own], learners.predict(m, x[~own])) for m in models]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(places)), pa.array(places, pa.int32()), pa.array([json.dumps(grids[name][i], sort_keys=True) for i in places]),
                                                  pa.array([fold] * len(places), pa.int32()), pa.array(scores, pa.float64())], names=["model", "candidate", "params", "fold", "recall"])

    jobs = [(name, places, int(f)) for name, places in shared_fits(grids) for f in np.unique(folds)]
    return _spread(spark, jobs, "model string, places array<int>, fold int").mapInArrow(run, "model string, candidate int, params string, fold int, recall double")


def candidate_table(scores: DataFrame) -> DataFrame:
    """M6/M7: (model, candidate, params, mean_recall, std_recall, rank), population std over the folds, ties to the earlier candidate."""
    table = scores.groupBy("model", "candidate", "params").agg(F.avg("recall").alias("mean_recall"), F.stddev_pop("recall").alias("std_recall"))
    # a row per candidate: the grid bounds it
    return table.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.round("mean_recall", 12).desc(), "candidate")))


def fitted(spark: SparkSession, jobs: list[tuple[str, dict, int | None]], x: np.ndarray, y: np.ndarray, folds: np.ndarray, ids: list) -> DataFrame:
    """(model, params, fold, blob, ids, p): fits on all rows (fold NULL), or without a fold, with the left-out rows' probabilities."""
    names = np.array(ids, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, params, fold in zip(b.column("model").to_pylist(), b.column("params").to_pylist(), b.column("fold").to_pylist()):
                out = folds == (-1 if fold is None else fold)
                model, = fit(name, [json.loads(params)], x[~out], y[~out])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([params]), pa.array([fold], pa.int32()), pa.array([learners.to_bytes(model)], pa.binary()),
                                                  pa.array([names[out].tolist()], pa.list_(pa.string())), pa.array([learners.predict(model, x[out]).tolist() if out.any() else []], pa.list_(pa.float64()))],
                                                 names=["model", "params", "fold", "blob", "ids", "p"])

    rows = [(name, json.dumps(params, sort_keys=True), fold) for name, params, fold in jobs]
    return _spread(spark, rows, "model string, params string, fold int").mapInArrow(run, "model string, params string, fold int, blob binary, ids array<string>, p array<double>")


def save_models(models: DataFrame, path: str) -> None:
    """K2: fitted models with their parameters as Parquet."""
    models.select("model", "params", "blob").write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[str, dict]:
    """Saved models by name; ``scores`` takes them."""
    return as_models(spark.read.parquet(path))


def as_models(rows: DataFrame) -> dict[str, dict]:
    """One model per name: bounded by the search's rows, not by the data that is scored."""
    return {r["model"]: learners.from_bytes(r["blob"]) for r in rows.select("model", "blob").orderBy("model").collect()}


def scores(df: DataFrame, vec_col: str, models: dict[str, dict], out: str = "p") -> DataFrame:
    """``df`` with a struct of every model's probability of class 1: all models in one pass."""
    names = list(models)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = b.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) if len(b) else np.zeros((0, 1))
            made = [pa.array(learners.predict(models[n], x) if len(b) else [], pa.float64()) for n in names]
            yield pa.StructArray.from_arrays(made, names)

    return df.withColumn(out, score(F.col(vec_col)))


def voting(names: list[str], p: str = "p"):
    """M8: the mean of the members' probabilities, a column of the scored rows."""
    return sum((F.col(f"{p}.{n}") for n in names[1:]), F.col(f"{p}.{names[0]}")) / len(names)


def stacking(names: list[str], weights: np.ndarray, p: str = "p"):
    """M9: logistic regression over the members' probabilities, a column of the scored rows."""
    z = sum((F.lit(float(w)) * F.col(f"{p}.{n}") for n, w in zip(names, weights)), F.lit(float(weights[-1])))
    return 1 / (1 + F.exp(-z))


def search(df: DataFrame, id_col: str, vec_col: str, label: str, fold: str, grids: dict[str, list[dict]] | None = None, top_n: int = TOP_N_ENSEMBLE, rows: int = SEARCH_ROWS) -> dict:
    """M6-M9 on a training frame with folds.

    Returns ``candidates`` (table), ``best`` ({model: parameters}), ``top``
    (members of the ensembles, by mean recall), ``fits`` (frame of the models
    fitted on all training rows), ``models`` and ``meta`` (stacking weights, from
    probabilities of rows that the members did not learn from).
    """
    spark = df.sparkSession
    grids = grids or {name: param_candidates(name) for name in GRIDS}
    x, y, folds, ids = training_rows(df, id_col, vec_col, label, fold, rows)
    table = kept(candidate_table(cross_validated(spark, grids, x, y, folds)), "candidates")
    first = {r["model"]: r for r in table.where("rank = 1").collect()}
    best = {name: grids[name][first[name]["candidate"]] for name in grids}
    order = list(grids)
    top = sorted(order, key=lambda n: (-round(first[n]["mean_recall"], 12), order.index(n)))[:top_n]
    jobs = [(n, best[n], int(f)) for n in top for f in np.unique(folds)] + [(n, best[n], None) for n in grids]
    fits = kept(fitted(spark, jobs, x, y, folds, ids), "fits")
    place = {i: k for k, i in enumerate(ids)}
    held = np.zeros((len(ids), len(top)))
    for r in fits.where("fold IS NOT NULL").select("model", "ids", "p").collect():
        held[[place[i] for i in r["ids"]], top.index(r["model"])] = r["p"]
    whole = fits.where("fold IS NULL")
    return {"candidates": table, "best": best, "top": top, "fits": whole, "models": as_models(whole), "meta": learners.newton_logistic(held, y, 1.0)}
