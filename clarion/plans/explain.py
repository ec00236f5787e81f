"""Registered explanation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarion.functions.columns import specimen_tag, squash
from clarion.operators import explain as ex
from clarion.operators import features as fe
from clarion.operators import raster as ra
from clarion.operators import split as sp
from clarion.plans import tabular as tb
from clarion.plans.common import Registry, finish
from clarion.plans.raster import REG as RASTER
from clarion.plans.sql import HEAT_MASK_CTE, LINE_FEATURES_CTE, r6, with_ctes
from clarion.session import kept
from clarion.sources import bindings as b

REG = Registry()
MODEL_SOURCE = "fixed coefficients"
PROVENANCE = ("score", "model_source", "is_demo")


def _scaled_split(spark, d):
    # feeds the background means, models and bins (train) and the explained rows (test): written once, scaled
    s = sp.stratified_split(b.line_features(spark, d), "label", "row_id", tb.TEST_FRACTION, tb.SEED)
    stats = fe.scaler_stats(s.where(F.col("split") == "train"), b.LINE_FEATURES)
    return kept(fe.apply_scaler(s, stats, b.LINE_FEATURES), "scaled-split")


def contribution_rows(spark, d):
    """row_id, model, score and the contributions of every test row, for both linear scorers."""
    z = _scaled_split(spark, d)
    train, test = z.where(F.col("split") == "train"), z.where(F.col("split") == "test")
    parts = [ex.contribution_rows(test.select("*", F.lit(name).alias("model"), squash(tb._zscore_logit(name)).alias("score"), F.lit(MODEL_SOURCE).alias("model_source"), F.lit(False).alias("is_demo")),
                                  ["row_id", "model", "score", "model_source", "is_demo"], list(w), w, train)
             for name, (_, w) in tb.SCALED_SCORERS.items()]
    return reduce(DataFrame.unionByName, parts)


def contributions(spark, d):
    return ex.linear_contributions(contribution_rows(spark, d).drop(*PROVENANCE))


def _contrib_sql_ctes() -> list[str]:
    parts = []
    for name, (b0, w) in tb.SCALED_SCORERS.items():
        score = f"(0.5 + 0.5 * ({tb._zscore_logit_sql(name)}) / (1.0 + abs({tb._zscore_logit_sql(name)})))"
        for feat, coef in w.items():
            parts.append(f"SELECT s.row_id, '{name}' AS model, '{feat}' AS feature, s.{feat} AS value, "
                         f"CAST({float(coef)!r} AS DOUBLE) * (s.{feat} - bg.m_{feat}) AS contribution, "
                         f"{score.replace('quantity', 's.quantity').replace('discount', 's.discount').replace('tax', 's.tax').replace('ext', 's.ext').replace('unit', 's.unit')} AS score "
                         f"FROM scaled s, bg WHERE s.split = 'test'")
    bg = ", ".join(f"avg({c}) AS m_{c}" for c in b.LINE_FEATURES)
    return [tb.SPLIT_SQL, *tb._scale_sql_ctes(), f"bg AS (SELECT {bg} FROM scaled WHERE split = 'train')",
            "contrib AS (" + " UNION ALL ".join(parts) + ")"]


@REG.add("linear_contributions", with_ctes(LINE_FEATURES_CTE, *_contrib_sql_ctes(), body=f"""
SELECT row_id, model, feature, {r6('value')} AS value, {r6('contribution')} AS contribution FROM contrib"""))
def linear_contributions(spark, d):
    return finish(contributions(spark, d))


@REG.add("top_contributors", with_ctes(LINE_FEATURES_CTE, *_contrib_sql_ctes(), """
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id, model ORDER BY abs(contribution) DESC, feature) AS rank
       FROM contrib)""", body=f"""
SELECT row_id, model, CAST(rank AS INTEGER) AS rank, feature, {r6('value')} AS value,
       {r6('contribution')} AS contribution FROM rk WHERE rank <= {ex.TOP_K_DEFAULT}"""))
def top_contributors(spark, d):
    return finish(ex.top_contributors(contribution_rows(spark, d).drop(*PROVENANCE), ex.TOP_K_DEFAULT))


@REG.add("global_importance", with_ctes(LINE_FEATURES_CTE, *_contrib_sql_ctes(), """
ga AS (SELECT model, feature, avg(abs(contribution)) AS mean_abs FROM contrib GROUP BY ALL)""", body=f"""
SELECT model, feature, {r6('mean_abs')} AS mean_abs,
       CAST(row_number() OVER (PARTITION BY model ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM ga"""))
def global_importance(spark, d):
    g = ex.global_importance(contributions(spark, d), ["model"])
    return finish(g.withColumn("rank", F.col("rank").cast("int")))


def _names_sql(arr: str) -> str:
    return f"array_to_string(list_transform({arr}[1:2], lambda n: replace(n, '_', ' ')), ' and ')"


@REG.add("summary_text", with_ctes(LINE_FEATURES_CTE, *_contrib_sql_ctes(), f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id, model ORDER BY abs(contribution) DESC, feature) AS rank
       FROM contrib)""", f"""
lst AS (SELECT row_id, model, CASE WHEN any_value(score) >= 0.5 THEN 'Malignant' ELSE 'Benign' END AS predicted_class,
               coalesce(list(feature ORDER BY rank) FILTER (WHERE contribution > 0), []) AS up,
               coalesce(list(feature ORDER BY rank) FILTER (WHERE contribution < 0), []) AS down
        FROM rk WHERE rank <= {ex.TOP_K_SERVICE} GROUP BY row_id, model)""", body=f"""
SELECT row_id, model, predicted_class,
  CASE WHEN lower(predicted_class) = 'malignant' AND len(up) > 0
         THEN 'This prediction is primarily driven by elevated ' || {_names_sql('up')} || ' values.'
       WHEN lower(predicted_class) = 'benign' AND len(down) > 0
         THEN 'This prediction is primarily driven by comparatively low ' || {_names_sql('down')} || ' values.'
       WHEN len(up) > 0 THEN 'This prediction is primarily driven by ' || {_names_sql('up')} || '.'
       WHEN len(down) > 0 THEN 'This prediction is primarily driven by ' || {_names_sql('down')} || '.'
       ELSE 'No single feature dominates this prediction.' END AS summary
FROM lst"""))
def summary_text(spark, d):
    return ex.drill_down(contribution_rows(spark, d)).select("row_id", "model", "predicted_class", "summary")


@REG.add("drill_down", with_ctes(LINE_FEATURES_CTE, *_contrib_sql_ctes(), """
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id, model ORDER BY abs(contribution) DESC, feature) AS rank
       FROM contrib)""", body=f"""
SELECT row_id, model, '{MODEL_SOURCE}' AS model_source, FALSE AS is_demo, {r6('any_value(score)')} AS score,
       CASE WHEN any_value(score) >= 0.5 THEN 'Malignant' ELSE 'Benign' END AS predicted_class,
       CASE WHEN any_value(score) < 0.35 THEN 'Low' WHEN any_value(score) < 0.65 THEN 'Moderate' ELSE 'High' END AS risk_tier,
       string_agg(feature, ',' ORDER BY rank) AS contributors, {r6('sum(contribution)')} AS contribution_sum
FROM rk WHERE rank <= {ex.TOP_K_SERVICE} GROUP BY row_id, model"""))
def drill_down(spark, d):
    """X3 over the whole test split."""
    x = ex.drill_down(contribution_rows(spark, d))
    total = F.aggregate("contributors", F.lit(0.0), lambda acc, s: acc + s["contribution"])
    return finish(x.select("row_id", "model", "model_source", "is_demo", "score", "predicted_class", "risk_tier",
                           F.array_join("contributors.feature", ",").alias("contributors"), total.alias("contribution_sum")))


_B36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@REG.add("specimen_tag", f"""
WITH h AS (SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda ch: CAST(unicode(ch) AS BIGINT)),
                                        lambda acc, c: (acc * 31 + c) % 4294967296) AS h FROM pages),
dg AS (SELECT page_id, h, list_transform(range(6, -1, -1),
          lambda i: substr('{_B36}', CAST((h // CAST(pow(36, i) AS BIGINT)) % 36 AS INTEGER) + 1, 1)) AS digits FROM h)
SELECT page_id, 'SPEC-' || CASE WHEN h >= 2176782336 THEN array_to_string(digits[1:6], '')
                               ELSE array_to_string(digits[2:7], '') END AS tag FROM dg""")
def specimen_tag_q(spark, d):
    return b.table(spark, d, "pages").select("page_id", specimen_tag("url").alias("tag"))


@REG.add("attention_narrative", f"""
WITH conc AS ({RASTER.oracles["attention_concentration"]}), tex AS ({RASTER.oracles["glcm_features"]})
SELECT image_id, concentration, CASE WHEN concentration > 0.4
    THEN 'Grad-CAM attention is concentrated on a localized region (attention concentration ' || printf('%.2f', concentration)
      || '), consistent with a discrete mass/calcification pattern, alongside a GLCM contrast of ' || printf('%.1f', glcm_contrast)
      || ' and homogeneity of ' || printf('%.2f', glcm_homogeneity) || ' in the analyzed region.'
    ELSE 'Grad-CAM attention is diffuse across the tissue (concentration ' || printf('%.2f', concentration)
      || ') rather than localized on a single structure, with a GLCM contrast of ' || printf('%.1f', glcm_contrast) || ' over the full patch.' END AS narrative
FROM conc JOIN tex USING (image_id)""")
def attention_narrative(spark, d):
    """X10 over every image: concentration of its heatmap with the texture of its grid."""
    conc = ra.attention_concentration(b.heat_mask(spark, d))
    tex = ra.glcm_features(b.grids(spark, d))
    j = finish(conc.join(tex, "image_id"))
    return j.select("image_id", "concentration", ex.attention_narrative(j).alias("narrative"))


@REG.add("shapley_contributions")
def shapley_contributions(spark, d):
    """X4(b): sampled Shapley values of a logistic model on the test rows
    (background: the 100-row hash sample of the train split, as the reference
    caps its explainer background).  Training-dependent: rows-only check."""
    z = _scaled_split(spark, d)
    feats = list(b.LINE_FEATURES)
    train = z.where(F.col("split") == "train")
    va = VectorAssembler(inputCols=feats, outputCol="features")
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=50).fit(
        va.transform(train).select("features", F.col("label").cast("double").alias("label")))
    pipe = PipelineModel(stages=[model])
    bg = sp.capped_sample(train, 100, "row_id", tb.SEED)
    test = z.where(F.col("split") == "test")
    return finish(ex.shapley_sampled(pipe, test, "row_id", feats, bg))


@REG.add("local_surrogate")
def local_surrogate(spark, d):
    """X6 for the most uncertain rows of the test split, the cases a reader opens: the 20 whose
    probability is nearest one half (a top-k report).  Training-dependent: rows-only check."""
    z = _scaled_split(spark, d)
    feats = list(b.LINE_FEATURES)
    train = z.where(F.col("split") == "train")
    va = VectorAssembler(inputCols=feats, outputCol="features")
    model = PipelineModel(stages=[LogisticRegression(featuresCol="features", labelCol="label", maxIter=50).fit(
        va.transform(train).select("features", F.col("label").cast("double").alias("label")))])
    test = z.where(F.col("split") == "test")
    near = model.transform(va.transform(test)).withColumn("_d", F.abs(vector_to_array("probability")[1] - 0.5))
    cases = near.orderBy("_d", "row_id").limit(20).select("row_id", *feats)
    return finish(ex.local_surrogate(model, cases, "row_id", feats, train))
