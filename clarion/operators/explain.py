"""Attributions and explanation text.

* X4(a) linear models: exact additive contributions w_i * (x_i - E[x_i]) in
  log-odds space (pure column expressions; the background mean is a one-row
  table broadcast to every task).
* X4(b) any model: permutation-sampled Shapley values -- rows x permutations x
  prefix positions are exploded, every coalition is scored by ONE
  ``model.transform``, and marginal differences are averaged with a groupBy.
* X6 local surrogate: perturbed neighbours per row, kernel weights, a weighted
  ridge fit per row from normal-equation sums (d^2 + d numbers a row, solved for
  a batch of rows at once in ``mapInPandas``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarion.operators.score import label_scores

TOP_K_DEFAULT = 5
TOP_K_SERVICE = 6
SUMMARY_NAMES = 2


def contribution_rows(df: DataFrame, id_cols: Sequence[str], features: Sequence[str],
                      coefs: dict[str, float], background: DataFrame) -> DataFrame:
    """X4(a): id columns and ``contributions``, one (feature, value, contribution) per feature, with
    contribution = w * (x - mean_background(x)) -- exact for linear models.  No shuffle of ``df``."""
    means = background.agg(*[F.avg(c).alias(f"_m_{c}") for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                              (F.lit(float(coefs.get(c, 0.0))) * (F.col(c) - F.col(f"_m_{c}"))).alias("contribution"))
                     for c in features])
    return df.crossJoin(F.broadcast(means)).select(*id_cols, rows.alias("contributions"))  # means: one row


def linear_contributions(rows: DataFrame) -> DataFrame:
    """X4(a) in long form: (id..., feature, value, contribution)."""
    return rows.select(*[c for c in rows.columns if c != "contributions"], F.inline("contributions"))


def ranked(contributions, k: int) -> Column:
    """W3 within a row: the k entries with the largest |contribution| (ties by feature name; NULL last)."""
    x = lambda s: s["contribution"]
    keyed = F.transform(contributions, lambda s: F.struct(
        x(s).isNull().alias("none"), (~F.isnan(x(s))).alias("number"), (-F.abs(x(s))).alias("size"), s["feature"].alias("feature"), s.alias("entry")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["entry"]), 1, k)


def top_contributors(rows: DataFrame, k: int = TOP_K_DEFAULT) -> DataFrame:
    """(id..., feature, value, contribution, rank) of every row's k strongest features, without a shuffle."""
    ids = [c for c in rows.columns if c != "contributions"]
    out = rows.select(*ids, F.posexplode(ranked("contributions", k)).alias("_at", "_e"))
    return out.select(*ids, "_e.*", (F.col("_at") + 1).alias("rank"))


def global_importance(contrib: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean |contribution| per feature, ranked descending."""
    g = list(group_cols)
    agg = contrib.groupBy(*g, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    w = Window.partitionBy(*g).orderBy(F.col("mean_abs").desc(), "feature")  # one row per feature
    return agg.withColumn("rank", F.row_number().over(w))


def summary_text(top: Column, predicted_class: Column, max_names: int = SUMMARY_NAMES) -> Column:
    """Plain-language sentence from a row's top contributors (an array in rank order).

    malignant and something pushes up -> "elevated a and b"; benign and
    something pushes down -> "comparatively low ..."; else whichever side
    exists; else "No single feature dominates".  At most two names, '_' -> ' '.
    """
    up = F.transform(F.filter(top, lambda s: s["contribution"] > 0), lambda s: s["feature"])
    down = F.transform(F.filter(top, lambda s: s["contribution"] < 0), lambda s: s["feature"])

    def names(arr):
        return F.array_join(F.transform(F.slice(arr, 1, max_names), lambda n: F.regexp_replace(n, "_", " ")), " and ")

    cls = F.lower(predicted_class)
    return (F.when((cls == "malignant") & (F.size(up) > 0),
                   F.concat(F.lit("This prediction is primarily driven by elevated "), names(up), F.lit(" values.")))
            .when((cls == "benign") & (F.size(down) > 0),
                  F.concat(F.lit("This prediction is primarily driven by comparatively low "), names(down),
                           F.lit(" values.")))
            .when(F.size(up) > 0, F.concat(F.lit("This prediction is primarily driven by "), names(up), F.lit(".")))
            .when(F.size(down) > 0, F.concat(F.lit("This prediction is primarily driven by "), names(down),
                                             F.lit(".")))
            .otherwise(F.lit("No single feature dominates this prediction.")))


def drill_down(rows: DataFrame, k: int = TOP_K_SERVICE) -> DataFrame:
    """Everything a service shows for a case: raw probability, class, tier and model source of the
    row, its k strongest contributors and the sentence.  ``rows`` are ``contribution_rows`` whose id
    columns include ``score`` (and the provenance columns), so nothing is joined."""
    out = label_scores(rows.withColumn("contributors", ranked("contributions", k)).drop("contributions"))
    return out.withColumn("summary", summary_text(F.col("contributors"), F.col("predicted_class")))


def attention_narrative(df: DataFrame, concentration: str = "concentration", contrast: str = "glcm_contrast",
                        homogeneity: str = "glcm_homogeneity", threshold: float = 0.4) -> F.Column:
    """Localized vs diffuse attention sentence (fixed text formats)."""
    c2 = F.format_string("%.2f", F.col(concentration))
    k1 = F.format_string("%.1f", F.col(contrast))
    h2 = F.format_string("%.2f", F.col(homogeneity))
    localized = F.concat(
        F.lit("Grad-CAM attention is concentrated on a localized region (attention concentration "), c2,
        F.lit("), consistent with a discrete mass/calcification pattern, alongside a GLCM contrast of "), k1,
        F.lit(" and homogeneity of "), h2, F.lit(" in the analyzed region."))
    diffuse = F.concat(
        F.lit("Grad-CAM attention is diffuse across the tissue (concentration "), c2,
        F.lit(") rather than localized on a single structure, with a GLCM contrast of "), k1,
        F.lit(" over the full patch."))
    return F.when(F.col(concentration) > threshold, localized).otherwise(diffuse)


# ------------------------------------------------------------------ X4(b) sampled Shapley

def shapley_sampled(model, rows: DataFrame, id_col: str, features: Sequence[str], background: DataFrame,
                    n_permutations: int = 16, seed: int = 42, prob_col: str = "probability",
                    features_col: str = "features") -> DataFrame:
    """X4(b): permutation-sampling Shapley values of P(class 1) for any fitted
    model whose input is a vector column assembled from ``features``.

    For each (row, permutation) a background row is drawn by content hash; the
    coalition after adding position j takes the row's values for the first j
    features of the permutation and the background's values for the rest.
    All coalitions of all rows are scored in one ``transform``; the
    contribution of a feature is the average score difference it makes.
    Local accuracy: sum of contributions = f(x) - mean over draws of f(background).
    """
    from pyspark.ml.feature import VectorAssembler
    d = len(features)
    # ``background`` is a bounded sample (T4: at most 100 rows in the reference)
    bg = background.select(*[F.col(c).cast("double").alias(c) for c in features]) \
        .withColumn("_bk", F.row_number().over(Window.orderBy(*features)) - 1)
    n_bg = bg.count()
    r = rows.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    perm_ids = F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("_perm")
    # permutation of feature positions by hash order, background row by hash; plain columns, which Spark compiles
    hashed = r.select("*", perm_ids).select(
        "*", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id"), F.col("_perm")), F.lit(n_bg)).alias("_bk"),
        *[F.xxhash64(F.lit(seed), F.col("_id"), F.col("_perm"), F.lit(i)).alias(f"_h{i}") for i in range(d)])

    def place(i: int) -> Column:
        """How many features stand before feature ``i`` in the permutation; equal hashes by number."""
        before = [F.col(f"_h{k}") <= F.col(f"_h{i}") if k < i else F.col(f"_h{k}") < F.col(f"_h{i}") for k in range(d) if k != i]
        return sum((b.cast("int") for b in before), F.lit(0)).alias(f"_p{i}")

    rp = hashed.select("_id", "_perm", "_bk", *[f"_x{i}" for i in range(d)], *[place(i) for i in range(d)])
    bgr = bg.select("_bk", *[F.col(c).alias(f"_b{i}") for i, c in enumerate(features)])
    # Spark broadcasts the background while it is small
    # step j = 0..d : first j features of the permutation come from x
    steps = rp.join(bgr, "_bk").select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_j"))
    coal = steps.select("_id", "_j", *[f"_p{i}" for i in range(d)],
                        *[F.when(F.col(f"_p{i}") < F.col("_j"), F.col(f"_x{i}")).otherwise(F.col(f"_b{i}")).alias(c) for i, c in enumerate(features)])
    va = VectorAssembler(inputCols=list(features), outputCol=features_col)
    scored = model.transform(va.transform(coal)).select(
        "_id", "_j", *[f"_p{i}" for i in range(d)], vector_to_array(prob_col)[1].alias("_f"))
    # a coalition's score counts for the feature that it adds and against the one that the next coalition adds;
    # a row's coalitions are made in one task, so what is shuffled is one row of sums per row
    sums = scored.groupBy("_id").agg(*[
        F.sum(F.when(F.col("_j") == F.col(f"_p{i}") + 1, F.col("_f")).when(F.col("_j") == F.col(f"_p{i}"), -F.col("_f")).otherwise(F.lit(0.0))).alias(f"_s{i}")
        for i in range(d)])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"_s{i}") / n_permutations).alias("contribution")) for i, c in enumerate(features)])
    return sums.select(F.col("_id").alias(id_col), F.inline(each))


# ------------------------------------------------------------------ X6 local surrogate

def local_surrogate(model, rows: DataFrame, id_col: str, features: Sequence[str], training: DataFrame,
                    n_samples: int = 5_000, num_features: int = 8, kernel_width: float | None = None,
                    seed: int = 42, prob_col: str = "probability", features_col: str = "features",
                    ridge: float = 1.0) -> DataFrame:
    """Quartile-discretised local linear surrogate per row.

    Perturbations: for every (row, sample) each feature is kept (its own bin)
    or replaced by a value drawn from a training quartile bin, both by content
    hash.  The binary 'same bin as the row' representation is weighted by an
    exponential kernel of the distance, a ridge model is fitted per row from
    weighted sums, and the ``num_features`` largest |weights| are reported with
    the row's bin as text ("a < f <= b")."""
    from pyspark.ml.feature import VectorAssembler
    d = len(features)
    kw = kernel_width if kernel_width is not None else float(np.sqrt(d) * 0.75)
    from clarion.functions.stats import exact_percentiles, unpivot_values
    qrows = exact_percentiles(unpivot_values(training, list(features)), "x", [0.25, 0.5, 0.75], ["column"]).collect()
    quart = {c: [0.0, 0.0, 0.0] for c in features}          # d x 3 numbers
    for qr in qrows:
        quart[qr["column"]][[0.25, 0.5, 0.75].index(qr["p"])] = float(qr["value"])
    r = rows.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in features])

    def bin_of(col, qs):
        return (F.when(col <= qs[0], 0).when(col <= qs[1], 1).when(col <= qs[2], 2).otherwise(3))

    ends = training.agg(*[F.min(c).alias(f"min_{c}") for c in features], *[F.max(c).alias(f"max_{c}") for c in features]).first()
    samples = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("_s"))
    cols = []
    for k, c in enumerate(features):
        qs = quart[c]
        edges = [float(ends[f"min_{c}"])] + qs + [float(ends[f"max_{c}"])]
        u = (F.pmod(F.xxhash64(F.lit(seed), F.col("_id"), F.col("_s"), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0)
        keep = (F.pmod(F.xxhash64(F.lit(seed + 7), F.col("_id"), F.col("_s"), F.lit(k)), F.lit(2)) == 0) | (F.col("_s") == 0)
        b = F.pmod(F.xxhash64(F.lit(seed + 13), F.col("_id"), F.col("_s"), F.lit(k)), F.lit(4)).cast("int")
        lo = F.element_at(F.array(*[F.lit(e) for e in edges[:-1]]), b + 1)
        hi = F.element_at(F.array(*[F.lit(e) for e in edges[1:]]), b + 1)
        drawn = lo + u * (hi - lo)
        cols.append(F.when(keep, F.col(c)).otherwise(drawn).alias(c))
        cols.append(F.when(keep, F.lit(1.0)).otherwise(
            (bin_of(drawn, qs) == bin_of(F.col(c), qs)).cast("double")).alias(f"_z{k}"))
    pert = samples.select("_id", "_s", *cols)
    va = VectorAssembler(inputCols=list(features), outputCol=features_col)
    scored = model.transform(va.transform(pert)).withColumn("_y", vector_to_array(prob_col)[1])
    dist = F.sqrt(sum(((1.0 - F.col(f"_z{k}")) ** 2 for k in range(d)), F.lit(0.0)))
    scored = scored.withColumn("_w", F.sqrt(F.exp(-(dist * dist) / (kw * kw))))
    # weighted normal equations with intercept: X = [1, z_0..z_{d-1}]
    xs = [F.lit(1.0)] + [F.col(f"_z{k}") for k in range(d)]
    sums = [F.sum(F.col("_w") * xs[a] * xs[b]).alias(f"_a{a}_{b}") for a in range(d + 1) for b in range(a, d + 1)]
    sums += [F.sum(F.col("_w") * xs[a] * F.col("_y")).alias(f"_b{a}") for a in range(d + 1)]
    ne = scored.groupBy("_id").agg(*sums)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            A = np.zeros((len(pdf), d + 1, d + 1))
            for a in range(d + 1):
                for b2 in range(a, d + 1):
                    A[:, a, b2] = A[:, b2, a] = pdf[f"_a{a}_{b2}"]
            A[:, 1:, 1:] += ridge * np.eye(d)
            coef = np.linalg.solve(A, pdf[[f"_b{a}" for a in range(d + 1)]].to_numpy()[:, :, None])[:, 1:, 0]
            yield pd.DataFrame({"_id": pdf["_id"].repeat(d).to_numpy(), "_k": np.tile(np.arange(d, dtype=np.int32), len(pdf)), "weight": coef.ravel()})

    id_type = rows.schema[id_col].dataType.simpleString()
    weights = ne.mapInPandas(solve, schema=f"_id {id_type}, _k int, weight double")
    names = F.array(*[F.lit(c) for c in features])
    texts = []
    for k, c in enumerate(features):
        qs = quart[c]
        texts.append(F.when(F.col(c) <= qs[0], F.format_string(f"{c} <= %.2f", F.lit(qs[0])))
                     .when(F.col(c) <= qs[1], F.format_string(f"%.2f < {c} <= %.2f", F.lit(qs[0]), F.lit(qs[1])))
                     .when(F.col(c) <= qs[2], F.format_string(f"%.2f < {c} <= %.2f", F.lit(qs[1]), F.lit(qs[2])))
                     .otherwise(F.format_string(f"{c} > %.2f", F.lit(qs[2]))))
    bins = r.select("_id", F.array(*texts).alias("_txt"))
    w = Window.partitionBy("_id").orderBy(F.abs("weight").desc(), "_k")
    top = weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= num_features)
    return top.join(bins, "_id").select(F.col("_id").alias(id_col), "rank",
                                        F.element_at(names, F.col("_k") + 1).alias("feature_name"),
                                        F.element_at("_txt", F.col("_k") + 1).alias("feature"), "weight")
