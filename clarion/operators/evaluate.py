"""Evaluation (E1-E11) as grouped aggregates over a long frame
``(group..., label, score | pred)`` -- one job for all models at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarion.functions.columns import safe_div
from clarion.functions.stats import running_totals
from clarion.session import kept

GRID_POINTS = 61  # fpr grid 0, 1/60, ..., 1 used to merge ROC curves


def _g(group_cols) -> list[str]:
    return [group_cols] if isinstance(group_cols, str) else list(group_cols or [])


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on the group keys; with no keys both sides are one-row tables."""
    return a.join(b, keys, how) if keys else a.crossJoin(b)


def confusion_counts(df: DataFrame, group_cols=("model",), label: str = "label", pred: str = "pred") -> DataFrame:
    """Tn, fp, fn, tp per group -- always four cells, even with one class."""
    g = _g(group_cols)
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*g).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def confusion_with_shares(df: DataFrame, group_cols=("model",), label="label", pred="pred") -> DataFrame:
    c = confusion_counts(df, group_cols, label, pred)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return c.select("*", *[(F.col(k) / n).alias(f"{k}_share") for k in ("tn", "fp", "fn", "tp")])


def report_from_counts(c: DataFrame, zero_value=0.0) -> DataFrame:
    """Accuracy, and precision / recall / f1 of class 1 with 0/0 -> ``zero_value``."""
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    precision = safe_div(tp, tp + fp, zero_value)
    recall = safe_div(tp, tp + fn, zero_value)
    f1 = safe_div(2 * tp, 2 * tp + fp + fn, zero_value)
    return c.select("*", safe_div(tp + tn, tp + tn + fp + fn, zero_value).alias("accuracy"),
                    precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def score_groups(df: DataFrame, group_cols=("model",), label="label", score="score") -> DataFrame:
    """(group..., score, pos, neg): one row per distinct score (ties collapse)."""
    g = _g(group_cols)
    return df.groupBy(*g, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _ranked_groups(df: DataFrame, group_cols, label, score) -> DataFrame:
    """Score groups with running totals in descending score order plus a 1-based rank."""
    g = _g(group_cols)
    sg = score_groups(df, g, label, score).withColumn("one", F.lit(1))
    return running_totals(sg, g, "score", ["pos", "neg", "one"], descending=True)


def auc(df: DataFrame, group_cols=("model",), label="label", score="score") -> DataFrame:
    """Mann-Whitney AUC with ties counted one half:
    sum_g neg_g * (positives strictly above + pos_g / 2) / (P * N); NULL with one class."""
    g = _g(group_cols)
    rg = _ranked_groups(df, g, label, score)
    above = F.col("cum_pos") - F.col("pos")
    agg = rg.groupBy(*g).agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2.0)).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    den = F.col("n_pos").cast("double") * F.col("n_neg")  # the product of two counts outgrows a long
    return agg.select(*g, "n_pos", "n_neg",
                      F.when(den == 0, F.lit(None).cast("double")).otherwise(F.col("_u") / den).alias("auc"))


def roc_curve(df: DataFrame, group_cols=("model",), label="label", score="score",
              drop_intermediate: bool = True) -> DataFrame:
    """(group..., idx, threshold, fpr, tpr).

    Distinct scores descending; a leading (0, 0) point (idx 0, NULL threshold);
    an interior point is dropped when its class counts equal the next group's
    (collinear).  The 'next group' is an equi-join on rank + 1, not a window.
    """
    g = _g(group_cols)
    # read for the points, the totals and the next points
    rg = kept(_ranked_groups(df, g, label, score).withColumnRenamed("cum_one", "idx"), "ranked-scores")
    # one row per group, written so that Spark knows its size: dealt by group, a curve would meet in one task
    totals = kept(rg.groupBy(*g).agg(F.max("idx").alias("_L"), F.sum("pos").alias("_P"), F.sum("neg").alias("_N")), "roc-totals")
    nxt = rg.select(*g, (F.col("idx") - 1).alias("idx"), F.col("pos").alias("_npos"), F.col("neg").alias("_nneg"))
    pts = _join(rg, totals, g).join(nxt, [*g, "idx"], "left")
    if drop_intermediate:
        keep = ((F.col("idx") == 1) | (F.col("idx") == F.col("_L")) | (F.col("_L") <= 2)
                | (F.col("pos") != F.col("_npos")) | (F.col("neg") != F.col("_nneg")))
        pts = pts.where(keep)
    fpr = F.when(F.col("_N") == 0, F.lit(None).cast("double")).otherwise(F.col("cum_neg") / F.col("_N"))
    tpr = F.when(F.col("_P") == 0, F.lit(None).cast("double")).otherwise(F.col("cum_pos") / F.col("_P"))
    body = pts.select(*g, F.col("idx").cast("bigint").alias("idx"), F.col("score").alias("threshold"),
                      fpr.alias("fpr"), tpr.alias("tpr"))
    origin = totals.select(*g, F.lit(0).cast("bigint").alias("idx"), F.lit(None).cast("double").alias("threshold"),
                           F.when(F.col("_N") == 0, F.lit(None).cast("double")).otherwise(F.lit(0.0)).alias("fpr"),
                           F.when(F.col("_P") == 0, F.lit(None).cast("double")).otherwise(F.lit(0.0)).alias("tpr"))
    return origin.unionByName(body)


def roc_nearest_grid(roc: DataFrame, group_cols=("model",), n_grid: int = GRID_POINTS) -> DataFrame:
    """For grid fpr g = i/(n-1) the ROC point with the nearest fpr, earliest on ties.

    The true nearest point is the largest fpr <= g or the smallest fpr >= g;
    both are a min or max of some grid cell, so per (group, cell) only the two
    extreme points are kept (a table of <= groups x 2n rows) before the argmin.
    """
    g = _g(group_cols)
    steps = n_grid - 1
    pts = roc.where(F.col("fpr").isNotNull()).groupBy(*g, "fpr").agg(
        F.min("idx").alias("idx"), F.min("tpr").alias("tpr"))
    cell = F.least(F.greatest(F.floor(F.col("fpr") * steps), F.lit(0)), F.lit(steps))
    ext = pts.withColumn("_cell", cell).groupBy(*g, "_cell").agg(
        F.min_by(F.struct("fpr", "idx", "tpr"), "fpr").alias("lo"),
        F.max_by(F.struct("fpr", "idx", "tpr"), "fpr").alias("hi"))
    cand = ext.select(*g, F.explode(F.array("lo", "hi")).alias("p")).select(*g, "p.*").distinct()
    spark = roc.sparkSession
    grid = spark.range(n_grid).select(F.col("id").cast("int").alias("grid_i"),
                                      (F.col("id") / float(steps)).alias("grid_fpr"))
    paired = cand.crossJoin(F.broadcast(grid))  # fixed n_grid rows x bounded candidates
    best = paired.groupBy(*g, "grid_i", "grid_fpr").agg(
        F.min_by(F.struct("fpr", "tpr", "idx"),
                 F.struct(F.abs(F.col("fpr") - F.col("grid_fpr")), F.col("idx"))).alias("b"))
    return best.select(*g, "grid_i", "grid_fpr", F.col("b.fpr").alias("fpr"), F.col("b.tpr").alias("tpr"))


def classification_table(df: DataFrame, group_cols=("model",), label="label", pred="pred",
                         score: str | None = "score") -> DataFrame:
    """E5: one row per model with accuracy, precision, recall, f1 and roc_auc."""
    g = _g(group_cols)
    rep = report_from_counts(confusion_counts(df, g, label, pred))
    if score is not None:
        rep = _join(rep, auc(df, g, label, score).select(*g, F.col("auc").alias("roc_auc")), g)
    return rep


def sens_spec(df: DataFrame, group_cols=("model",), label="label", pred="pred", score="score") -> DataFrame:
    """Sensitivity / specificity (NULL when undefined) and guarded AUC."""
    g = _g(group_cols)
    c = confusion_counts(df, g, label, pred)
    out = c.select(*g, "tn", "fp", "fn", "tp",
                   safe_div(F.col("tp"), F.col("tp") + F.col("fn"), None).alias("sensitivity"),
                   safe_div(F.col("tn"), F.col("tn") + F.col("fp"), None).alias("specificity"))
    return _join(out, auc(df, g, label, score).select(*g, "auc"), g)


def auc_gap(df: DataFrame, dataset_col: str, in_name: str, out_name: str,
            group_cols=("model",), label="label", score="score") -> DataFrame:
    """AUC(in-distribution) - AUC(zero-shot) per model."""
    g = _g(group_cols)
    a = auc(df, [*g, dataset_col], label, score)
    wide = a.groupBy(*g).pivot(dataset_col, [in_name, out_name]).agg(F.first("auc"))
    return wide.select(*g, F.col(in_name).alias("auc_in"), F.col(out_name).alias("auc_out"),
                       (F.col(in_name) - F.col(out_name)).alias("auc_gap"))


def ari_nmi(df: DataFrame, truth: str, pred: str, group_cols=()) -> DataFrame:
    """Adjusted Rand index (pair-confusion form) and NMI with arithmetic
    normaliser and natural log.  Noise (-1) is an ordinary cluster here."""
    g = _g(group_cols)
    ct = df.groupBy(*g, truth, pred).agg(F.count(F.lit(1)).alias("nij"))
    rows = ct.groupBy(*g, truth).agg(F.sum("nij").alias("ai"))
    cols = ct.groupBy(*g, pred).agg(F.sum("nij").alias("bj"))
    n_tab = rows.groupBy(*g).agg(F.sum("ai").alias("n"), F.count(F.lit(1)).alias("n_true"),
                                 F.sum(F.col("ai").cast("double") ** 2).alias("sa2"),
                                 F.sum(-(F.col("ai") * F.log("ai"))).alias("_ha_raw"))
    c_tab = cols.groupBy(*g).agg(F.count(F.lit(1)).alias("n_pred"),
                                 F.sum(F.col("bj").cast("double") ** 2).alias("sb2"),
                                 F.sum(-(F.col("bj") * F.log("bj"))).alias("_hb_raw"))
    cells = _join(ct.join(rows, [*g, truth]).join(cols, [*g, pred]), n_tab.select(*g, "n"), g)
    nd = F.col("n").cast("double")
    term = ((F.col("nij") / nd) * (F.log("nij") - F.log(nd))
            + (F.col("nij") / nd) * (-F.log(F.col("ai").cast("double") * F.col("bj")) + F.log(nd) + F.log(nd)))
    cell_sums = cells.groupBy(*g).agg(F.sum(F.col("nij").cast("double") ** 2).alias("s2"),
                                      F.sum(term).alias("_mi"))
    t = _join(_join(cell_sums, n_tab, g), c_tab, g)
    n2 = F.col("n").cast("double") * F.col("n")
    tp = F.col("s2") - F.col("n")
    fp = F.col("sb2") - F.col("s2")
    fn = F.col("sa2") - F.col("s2")
    tn = n2 - fp - fn - F.col("s2")
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    # entropies: -sum p log p = (sum -c log c)/n + log n
    ha = F.col("_ha_raw") / nd + F.log(nd)
    hb = F.col("_hb_raw") / nd + F.log(nd)
    mi = F.when((F.col("n_true") == 1) | (F.col("n_pred") == 1), F.lit(0.0)).otherwise(F.greatest(F.col("_mi"), F.lit(0.0)))
    nmi = (F.when((F.col("n_true") == 1) & (F.col("n_pred") == 1), F.lit(1.0))
           .when(mi == 0, F.lit(0.0))
           .otherwise(mi / ((ha + hb) / 2.0)))
    return t.select(*g, "n", ari.alias("ari"), nmi.alias("nmi"))


def silhouette_sq_frame(df: DataFrame, id_col: str, features: str, cluster: str,
                        group_cols: Sequence[str] = ()) -> DataFrame:
    """E8 as a relational job: per-cluster (count, vector sum, sum of squared
    norms) -- a table of k rows per group -- give every point's mean squared
    distance to each cluster; same definition as MLlib's evaluator (own cluster
    excludes the point itself, a singleton scores 0), noise (-1) removed."""
    g = _g(group_cols)
    valid = df.where(F.col(cluster) != -1).select(*g, F.col(id_col).alias("_id"), F.col(cluster).alias("_k"),
                                                  F.col(features).alias("_v"))
    valid = valid.withColumn("_sq", F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x))
    dims = valid.select(F.size("_v").alias("d")).first()["d"]
    cstats = valid.groupBy(*g, "_k").agg(
        F.count(F.lit(1)).alias("_nk"), F.sum("_sq").alias("_psi"),
        F.array(*[F.sum(F.col("_v")[i]) for i in range(dims)]).alias("_y"))
    # every point against every cluster of its group: points x k (k is small)
    pairs = valid.join(cstats.withColumnRenamed("_k", "_ko"), g) if g else valid.crossJoin(
        F.broadcast(cstats.withColumnRenamed("_k", "_ko")))
    dot = F.aggregate(F.arrays_zip("_v", "_y"), F.lit(0.0), lambda acc, z: acc + z["_v"] * z["_y"])
    dist = F.col("_sq") + F.col("_psi") / F.col("_nk") - 2 * dot / F.col("_nk")
    per = pairs.select(*g, "_id", "_k", "_ko", "_nk", dist.alias("_d"))
    own = per.where(F.col("_k") == F.col("_ko")).select(
        *g, "_id", F.when(F.col("_nk") == 1, F.lit(None)).otherwise(
            F.col("_d") * F.col("_nk") / (F.col("_nk") - 1)).alias("_a"), F.col("_nk").alias("_own_n"))
    other = per.where(F.col("_k") != F.col("_ko")).groupBy(*g, "_id").agg(F.min("_d").alias("_b"))
    s = own.join(other, [*g, "_id"]).select(
        *g, F.when(F.col("_own_n") == 1, F.lit(0.0))
        .when(F.col("_a") < F.col("_b"), 1 - F.col("_a") / F.col("_b"))
        .when(F.col("_a") > F.col("_b"), F.col("_b") / F.col("_a") - 1)
        .otherwise(F.lit(0.0)).alias("_s"))
    return s.groupBy(*g).agg(F.avg("_s").alias("silhouette_sq"), F.count(F.lit(1)).alias("n"))


def roc_downsample(roc: DataFrame, group_cols=("model",), target_points: int = 60) -> DataFrame:
    """Every step-th ROC point, step = max(1, n // 60) with n the number of
    points of the curve; the last point (1, 1) is always kept (the reference
    could lose it).  Positions come from running totals, not a global window."""
    g = _g(group_cols)
    ones = roc.withColumn("_one", F.lit(1)).withColumn("_o", F.col("idx").cast("double"))
    pos = running_totals(ones, g, "_o", ["_one"], descending=False, prefix="_cum")
    n = kept(pos.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")), "roc-points")
    step = F.greatest(F.lit(1), (F.col("_n") / target_points).cast("long"))
    j = _join(pos, n, g).withColumn("_pos", F.col("_cum_one") - 1)
    keep = ((F.col("_pos") % step) == 0) | (F.col("_pos") == F.col("_n") - 1)
    return j.where(keep).select(*g, "idx", "fpr", "tpr")
