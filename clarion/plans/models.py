"""Registered imbalance / model / anomaly queries (F6, M1-M12) over the
``doc_features`` binding (genuinely skewed labels) and ``vectors``.

Trained-model outputs get rows-only checks (plus invariants in tests); the
SMOTE class counts are deterministic and have a SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clarion.functions.columns import threshold_label
from clarion.operators import anomaly as an
from clarion.operators import evaluate as ev
from clarion.operators import features as fe
from clarion.operators import imbalance as im
from clarion.operators import models as mo
from clarion.operators import search as se
from clarion.operators import split as sp
from clarion.plans.common import Registry, finish
from clarion.plans.sql import doc_features_cte, split_cte, with_ctes
from clarion.session import kept
from clarion.sources import bindings as b

REG = Registry()
SEED = 42


def scaled_docs(spark, d):
    """doc_features -> split -> standardised on train -> (doc_id, vec, label, split, fold)."""
    # the texts are read once; the split and the scaler read a few numbers of each
    df = kept(b.doc_features(spark, d).withColumn("row_id", F.col("doc_id").cast("string")), "doc-features")
    s = sp.stratified_split(df, "label", "row_id", 0.2, SEED)
    stats = fe.scaler_stats(s.where(F.col("split") == "train"), b.DOC_FEATURES)
    z = fe.apply_scaler(s, stats, b.DOC_FEATURES)
    return z.withColumn("v", F.array(*[F.col(c) for c in b.DOC_FEATURES]))


@REG.add("smote_counts", with_ctes(doc_features_cte(), """
c AS (SELECT label, count(*) AS n FROM doc_features GROUP BY label)""", """
m AS (SELECT max(n) AS mx FROM c)""", body="""
SELECT label, FALSE AS synthetic, n FROM c
UNION ALL SELECT label, TRUE AS synthetic, mx - n AS n FROM c, m WHERE mx - n > 0"""))
def smote_counts(spark, d):
    """F6 on every labelled document (standardised features)."""
    z = scaled_docs(spark, d)
    res = im.smote(z, "doc_id", "v", "label", im.SMOTE_K, SEED)
    return res.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@REG.add("smote_fold_counts", with_ctes(doc_features_cte(), """
doc_rows AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, label FROM doc_features)""", split_cte("doc_rows"), f"""
folded AS (SELECT label, split, (row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}' || '|' || row_id)) - 1) % {mo.FOLDS} AS fold FROM split_rows)""", f"""
parts AS (SELECT CAST(held AS INTEGER) AS held, label, count(*) FILTER (fold <> held) AS n FROM folded, (SELECT unnest(range(0, {mo.FOLDS})) AS held) WHERE split = 'train' GROUP BY ALL)""", """
most AS (SELECT held, max(n) AS mx FROM parts GROUP BY held)""", body="""
SELECT held, label, mx - n AS n FROM parts JOIN most USING (held) WHERE mx > n AND n >= 2"""))
def smote_fold_counts(spark, d):
    """F6 fold by fold: synthetic rows of each training part (no parent in the held fold)."""
    train, _ = _folded(spark, d)
    made = im.smote_in_folds(train, "doc_id", "v", "label", "fold", mo.FOLDS, im.SMOTE_K, SEED)
    return made.groupBy("held", "label").agg(F.count(F.lit(1)).alias("n"))


def _fit_eval(name, params, train, test):
    n = train.count()
    model = mo.make_estimator(name, params, n, len(b.DOC_FEATURES), SEED).fit(train)
    return mo.positive_probability(model, test, "score")


@REG.add("resampling_effect")
def resampling_effect(spark, d):
    """The same logistic regression without and with SMOTE on the
    training rows, evaluated on the held-out rows."""
    z = kept(scaled_docs(spark, d), "scaled")
    train = z.where(F.col("split") == "train")
    test = mo.vector_column(z.where(F.col("split") == "test"), "v").select(
        F.col("doc_id").cast("string").alias("id"), "features", F.col("label").cast("double").alias("label"))
    base = mo.vector_column(train, "v").select("features", F.col("label").cast("double").alias("label"))
    made = kept(im.smote(train, "doc_id", "v", "label", im.SMOTE_K, SEED), "resampled")
    res = mo.vector_column(made, "v").select("features", F.col("label").cast("double").alias("label"))
    rows = []
    for run, tr in (("baseline_no_smote", base), ("with_smote", res)):
        p = _fit_eval("logistic_regression", {"C": 1.0}, tr, test)
        rows.append(p.select(F.lit(run).alias("model"), "label", "score", threshold_label("score").alias("pred")))
    long_df = rows[0].unionByName(rows[1])
    return finish(ev.classification_table(long_df, ["model"], "label", "pred", "score"), 4)


def _folded(spark, d):
    z = kept(sp.stratified_folds(scaled_docs(spark, d), "label", "row_id", mo.FOLDS, SEED), "folded")
    return z.where("split = 'train'"), z.where("split = 'test'")


@REG.add("ensemble_comparison")
def ensemble_comparison(spark, d):
    """M1-M9: the candidates of all five models searched on recall of class 1
    (stratified folds, T3), the best of each fitted on the training rows; top 3
    by mean recall vote and are stacked; one grouped evaluation of all models on
    the held-out rows, which meet every model in one pass."""
    train, test = _folded(spark, d)
    found = se.search(train, "row_id", "v", "label", "fold")
    scored = se.scores(test.select("row_id", "v", "label"), "v", found["models"])
    each = [F.struct(F.lit(n).alias("model"), F.col(f"p.{n}").alias("score")) for n in found["models"]]
    each.append(F.struct(F.lit("ensemble_voting").alias("model"), se.voting(found["top"]).alias("score")))
    each.append(F.struct(F.lit("ensemble_stacking").alias("model"), se.stacking(found["top"], found["meta"]).alias("score")))
    rows = kept(scored.select("row_id", "label", F.explode(F.array(*each)).alias("m")).select("row_id", "label", "m.*"), "scored")
    table = ev.classification_table(rows.withColumn("pred", threshold_label("score")), ["model"], "label", "pred", "score")
    best = found["candidates"].where("rank = 1").select("model", "params", "mean_recall", "std_recall")
    return finish(table.join(best, "model", "left").select("model", "accuracy", "precision", "recall", "f1", "roc_auc", "params", "mean_recall", "std_recall"), 4)


@REG.add("search_candidates")
def search_candidates(spark, d):
    """M6/M7: mean and std of the folds' recall for every candidate of every model."""
    train, _ = _folded(spark, d)
    x, y, folds, _ = se.training_rows(train, "row_id", "v", "label", "fold")
    grids = {name: mo.param_candidates(name) for name in mo.GRIDS}
    return finish(se.candidate_table(se.cross_validated(spark, grids, x, y, folds)))


@REG.add("anomaly_threshold")
def anomaly_threshold(spark, d):
    """Linear autoencoder (PCA, k = 8) on the 'normal' vectors (label 0)
    of the training split; every vector scored; strict > threshold."""
    vec = b.vectors(spark, d).withColumn("row_id", F.col("vec_id").cast("string"))
    vec = vec.withColumn("label", (F.col("true_label") != 0).cast("int"))
    s = kept(sp.stratified_split(vec, "label", "row_id", 0.2, SEED), "split")
    return finish(an.anomaly_scores(s, "vec_id", "v", (F.col("split") == "train") & (F.col("label") == 0)))
