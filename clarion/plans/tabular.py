"""Registered queries over the tabular bindings: quality, split, scaling,
pruning, weights, scoring and evaluation.  Each has a DuckDB oracle."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from clarion.functions.columns import squash
from clarion.operators import evaluate as ev
from clarion.operators import features as fe
from clarion.operators import quality as qa
from clarion.operators import score as sc
from clarion.operators import split as sp
from clarion.plans.common import Registry, finish
from clarion.plans.sql import (
    LINE_FEATURES_CTE, doc_features_cte, r6, scored_cte, split_cte, squash_sql, with_ctes, with_missing_cte)
from clarion.sources import bindings as b

REG = Registry()
ALL_COLS = [*b.LINE_FEATURES, "label"]
BOX_FEATURES = ["quantity", "ext", "discount", "tax"]
SEED = 42
TEST_FRACTION = 0.2
FOLDS = 5

# Fixed-coefficient scorers over *standardised* features (flagship slice).
SCALED_SCORERS = {
    "zlin_a": (-0.7, {"quantity": 0.35, "discount": 0.25, "tax": -0.15}),
    "zlin_b": (-0.6, {"ext": -0.3, "unit": 0.2}),
}


def _lit_sql(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


# ---------------------------------------------------------------- quality

def _missing_sql() -> str:
    parts = []
    for c in ALL_COLS:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c != "label" else "")
        parts.append(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {cond}) AS n_missing FROM with_missing")
    return with_ctes(with_missing_cte(), body="SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_missing > 0")


@REG.add("quality_missing", _missing_sql())
def quality_missing(spark, d):
    return qa.missing_by_column(b.with_missing(spark, d), ALL_COLS)


@REG.add("quality_duplicates", with_ctes(with_missing_cte(), body="""
SELECT CAST(sum(cnt) AS BIGINT) AS n_rows, CAST(sum(cnt - 1) AS BIGINT) AS n_duplicates,
       count(*) AS n_distinct, CAST(9 AS INTEGER) AS n_cols
FROM (SELECT count(*) AS cnt FROM with_missing GROUP BY ALL_COLUMNS_PLACEHOLDER)""".replace(
    "ALL_COLUMNS_PLACEHOLDER", ", ".join(["row_id", *ALL_COLS]))))
def quality_duplicates(spark, d):
    return qa.duplicate_summary(b.with_missing(spark, d))


@REG.add("class_balance", with_ctes(LINE_FEATURES_CTE, body=f"""
SELECT label, count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()')} AS share
FROM line_features GROUP BY label"""))
def class_balance(spark, d):
    return finish(qa.class_balance(b.line_features(spark, d), "label"))


def _dedup_impute_sql() -> str:
    meds = ", ".join(f"median({c}) AS m_{c}" for c in b.LINE_FEATURES)
    parts = [f"SELECT '{c}' AS \"column\", {r6(f'any_value(m_{c})')} AS median, "
             f"{r6(f'avg(coalesce({c}, m_{c}))')} AS mean_after, count(*) AS n_rows FROM dd, med"
             for c in b.LINE_FEATURES]
    return with_ctes(with_missing_cte(), "dd AS (SELECT DISTINCT * FROM with_missing)",
                     f"med AS (SELECT {meds} FROM dd)", body=" UNION ALL ".join(parts))


@REG.add("dedup_impute_summary", _dedup_impute_sql())
def dedup_impute_summary(spark, d):
    # read by the median pass and by the fill: one shuffle for the de-duplication
    dd = qa.drop_exact_duplicates(b.with_missing(spark, d)).persist(StorageLevel.MEMORY_AND_DISK)
    filled, med = qa.impute_median(dd, b.LINE_FEATURES)
    after = filled.agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in b.LINE_FEATURES])
    long_after = after.unpivot(["n_rows"], b.LINE_FEATURES, "column", "mean_after")
    return finish(med.join(long_after, "column").select("column", "median", "mean_after", "n_rows"))


@REG.add("column_defaults", with_ctes(LINE_FEATURES_CTE, body=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r6(f'median({c})')} AS median FROM line_features" for c in b.LINE_FEATURES)))
def column_defaults(spark, d):
    return finish(qa.column_medians(b.line_features(spark, d), b.LINE_FEATURES))


def _pairs(cols):
    return [(a, c) for i, a in enumerate(cols) for c in cols[i + 1:]]


@REG.add("corr_long", with_ctes(LINE_FEATURES_CTE, body=" UNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{c}' AS col_j, {r6(f'corr({a}, {c})')} AS r FROM line_features"
    for a, c in _pairs(ALL_COLS))))
def corr_long(spark, d):
    return finish(qa.correlation_long(b.line_features(spark, d), ALL_COLS))


@REG.add("corr_missing", with_ctes(with_missing_cte(), body=" UNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{c}' AS col_j, {r6(f'corr({a}, {c}) FILTER ({a} IS NOT NULL AND {c} IS NOT NULL)')} AS r FROM with_missing"
    for a, c in _pairs(ALL_COLS))))
def corr_missing(spark, d):
    """Q9 where values are missing: each pair over the rows that have both."""
    return finish(qa.correlation_long(b.with_missing(spark, d), ALL_COLS))


@REG.add("corr_family", with_ctes(LINE_FEATURES_CTE, body=" UNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{c}' AS col_j, {r6(f'corr({a}, {c})')} AS r FROM line_features"
    for a, c in _pairs(["ext", "net", "label"]))))
def corr_family(spark, d):
    """The price family and the label, then Q9 over them."""
    chosen = sc.select_family(b.line_features(spark, d), b.FAMILIES["price"], extra=["label"])
    return finish(qa.correlation_long(chosen, chosen.columns))


def _box_sql() -> str:
    unp = " UNION ALL ".join(f"SELECT label, '{c}' AS feature, {c} AS x FROM line_features" for c in BOX_FEATURES)
    return with_ctes(LINE_FEATURES_CTE, f"lg AS ({unp})", """
q AS (SELECT label, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM lg GROUP BY label, feature)""", body=f"""
SELECT q.label, q.feature, {r6('any_value(q.q1)')} AS q1, {r6('any_value(q.median)')} AS median,
       {r6('any_value(q.q3)')} AS q3,
       {r6('min(x) FILTER (WHERE x >= q.q1 - 1.5 * (q.q3 - q.q1) AND x <= q.q3 + 1.5 * (q.q3 - q.q1))')} AS whisker_low,
       {r6('max(x) FILTER (WHERE x >= q.q1 - 1.5 * (q.q3 - q.q1) AND x <= q.q3 + 1.5 * (q.q3 - q.q1))')} AS whisker_high,
       count(*) FILTER (WHERE NOT (x >= q.q1 - 1.5 * (q.q3 - q.q1) AND x <= q.q3 + 1.5 * (q.q3 - q.q1))) AS n_outliers,
       count(*) AS n
FROM lg JOIN q USING (label, feature) GROUP BY q.label, q.feature""")


@REG.add("box_summary", _box_sql())
def box_summary(spark, d):
    return finish(qa.box_summary(b.line_features(spark, d), BOX_FEATURES, "label"))


# ---------------------------------------------------------------- split / folds

def split_lines(spark, d):
    return sp.stratified_split(b.line_features(spark, d), "label", "row_id", TEST_FRACTION, SEED)


SPLIT_SQL = split_cte("line_features", TEST_FRACTION, SEED, "split_rows")


@REG.add("stratified_split_counts", with_ctes(LINE_FEATURES_CTE, SPLIT_SQL, body="""
SELECT label, split, count(*) AS n FROM split_rows GROUP BY label, split"""))
def stratified_split_counts(spark, d):
    return split_lines(spark, d).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@REG.add("kfold_counts", with_ctes(LINE_FEATURES_CTE, body=f"""
SELECT label, fold, count(*) AS n FROM (
  SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}' || '|' || row_id)) - 1)
                     % {FOLDS} AS INTEGER) AS fold FROM line_features)
GROUP BY label, fold"""))
def kfold_counts(spark, d):
    folds = sp.stratified_folds(b.line_features(spark, d), "label", "row_id", FOLDS, SEED)
    return folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- scaling / pruning / weights

def _scale_sql_ctes() -> list[str]:
    stats = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in b.LINE_FEATURES)
    scaled = ", ".join(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END AS {c}" for c in b.LINE_FEATURES)
    return [f"st AS (SELECT {stats} FROM split_rows WHERE split = 'train')",
            f"scaled AS (SELECT row_id, {scaled}, label, split FROM split_rows, st)"]


def scaled_lines(spark, d):
    s = split_lines(spark, d).persist(StorageLevel.MEMORY_AND_DISK)  # scaler fit + its application
    stats = fe.scaler_stats(s.where(F.col("split") == "train"), b.LINE_FEATURES)
    return fe.apply_scaler(s, stats, b.LINE_FEATURES)


@REG.add("standardized_stats", with_ctes(LINE_FEATURES_CTE, SPLIT_SQL, *_scale_sql_ctes(), body=" UNION ALL ".join(
    f"SELECT split, '{c}' AS \"column\", {r6(f'avg({c})')} AS mean, {r6(f'stddev_pop({c})')} AS std "
    f"FROM scaled GROUP BY split" for c in b.LINE_FEATURES)))
def standardized_stats(spark, d):
    s = scaled_lines(spark, d)
    agg = s.groupBy("split").agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
                                   for c in b.LINE_FEATURES])
    long_df = agg.unpivot(["split"], b.LINE_FEATURES, "column", "_s")  # one Expand, not a union of scans
    return finish(long_df.select("split", "column", "_s.mean", "_s.std"))


def _prune_sql() -> str:
    pos = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\"" for i, c in enumerate(b.LINE_FEATURES))
    pairs = " UNION ALL ".join(
        f"SELECT '{c}' AS col_j, abs(corr({a}, {c})) AS ar FROM split_rows WHERE split = 'train'"
        for a, c in _pairs(b.LINE_FEATURES))
    return with_ctes(LINE_FEATURES_CTE, SPLIT_SQL, f"pos AS ({pos})", f"pr AS ({pairs})",
                     "dropped AS (SELECT DISTINCT col_j FROM pr WHERE ar > 0.95)",
                     body="SELECT CAST(position AS INTEGER) AS position, \"column\", "
                          "\"column\" NOT IN (SELECT col_j FROM dropped) AS kept FROM pos")


@REG.add("corr_pruned_columns", _prune_sql())
def corr_pruned_columns(spark, d):
    train = split_lines(spark, d).where(F.col("split") == "train")
    return fe.correlation_prune(train, b.LINE_FEATURES, fe.PRUNE_THRESHOLD)


@REG.add("class_weights", with_ctes(doc_features_cte(), body=f"""
SELECT label, count(*) AS n, {r6('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight
FROM doc_features GROUP BY label"""))
def class_weights(spark, d):
    return finish(fe.class_weights(b.doc_features(spark, d), "label"))


# ---------------------------------------------------------------- scoring

SCORED_SQL = scored_cte("line_features")


def labelled_scores(spark, d):
    return sc.label_scores(b.scored(spark, d))


_TIER = "CASE WHEN score < 0.35 THEN 'Low' WHEN score < 0.65 THEN 'Moderate' ELSE 'High' END"
_CLASS = "CASE WHEN score >= 0.5 THEN 'Malignant' ELSE 'Benign' END"


@REG.add("scored_rows", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, body=f"""
SELECT row_id, model, {_CLASS} AS predicted_class, {r6('round(score, 4)')} AS probability_malignant,
       {_TIER} AS risk_tier FROM scored"""))
def scored_rows(spark, d):
    return finish(labelled_scores(spark, d).select("row_id", "model", "predicted_class",
                                                   "probability_malignant", "risk_tier"))


@REG.add("risk_tiers", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, body=f"""
SELECT model, {_TIER} AS risk_tier, count(*) AS n FROM scored GROUP BY ALL"""))
def risk_tiers(spark, d):
    return labelled_scores(spark, d).groupBy("model", "risk_tier").agg(F.count(F.lit(1)).alias("n"))


@REG.add("batch_summary", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, body=f"""
SELECT model, count(*) AS n_rows, count(*) FILTER (WHERE score >= 0.5) AS n_malignant,
       count(*) FILTER (WHERE score < 0.5) AS n_benign FROM scored GROUP BY model"""))
def batch_summary(spark, d):
    return sc.batch_summary(labelled_scores(spark, d))


_CM_SQL = """SELECT model, count(*) FILTER (WHERE label <> 1 AND NOT score >= 0.5) AS tn,
       count(*) FILTER (WHERE label <> 1 AND score >= 0.5) AS fp,
       count(*) FILTER (WHERE label = 1 AND NOT score >= 0.5) AS fn,
       count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM {src} GROUP BY model"""


@REG.add("confusion_by_model", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, f"cm AS ({_CM_SQL.format(src='scored')})",
                                         body="SELECT model, tn, fp, fn, tp, " + ", ".join(
                                             f"{r6(f'{k} / (tn + fp + fn + tp)')} AS {k}_share"
                                             for k in ("tn", "fp", "fn", "tp")) + " FROM cm"))
def confusion_by_model(spark, d):
    return finish(ev.confusion_with_shares(labelled_scores(spark, d), ["model"], "label", "pred"))


def _auc_sql(src: str, keys: str = "model") -> str:
    return f"""SELECT {keys}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  CASE WHEN sum(pos) * sum(neg) = 0 THEN NULL ELSE
    sum(neg * ((cum_pos - pos) + pos / 2.0)) / (sum(pos) * sum(neg)) END AS auc
FROM (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos
      FROM (SELECT {keys}, score, count(*) FILTER (WHERE label = 1) AS pos,
                   count(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY {keys}, score))
GROUP BY {keys}"""


def _report_sql(cm: str, auc: str) -> str:
    return f"""SELECT cm.model, {r6('CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END')} AS accuracy,
  {r6('CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END')} AS precision,
  {r6('CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END')} AS recall,
  {r6('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END')} AS f1,
  {r6('a.auc')} AS roc_auc, tn, fp, fn, tp
FROM {cm} cm JOIN {auc} a USING (model)"""


# ---- flagship: scan -> dedup -> split -> scale (fit on train) -> score -> per-model table

def _zscore_logit(name: str):
    b0, w = SCALED_SCORERS[name]
    expr = F.lit(b0)
    for feat, coef in w.items():
        expr = expr + F.lit(coef) * F.col(feat)
    return expr


def _zscore_logit_sql(name: str) -> str:
    b0, w = SCALED_SCORERS[name]
    expr = _lit_sql(b0)
    for feat, coef in w.items():
        expr = f"({expr} + {_lit_sql(coef)} * {feat})"
    return expr


def flagship_scores(spark, d):
    # the de-duplicated rows feed three split passes and the split feeds the
    # scaler fit and the scoring: keep each once instead of re-shuffling
    lf = qa.drop_exact_duplicates(b.line_features(spark, d)).persist(StorageLevel.MEMORY_AND_DISK)
    s = sp.stratified_split(lf, "label", "row_id", TEST_FRACTION, SEED).persist(StorageLevel.MEMORY_AND_DISK)
    stats = fe.scaler_stats(s.where(F.col("split") == "train"), b.LINE_FEATURES)
    test = fe.apply_scaler(s.where(F.col("split") == "test"), stats, b.LINE_FEATURES)
    models = F.array(*[F.struct(F.lit(n).alias("model"), squash(_zscore_logit(n)).alias("score"))
                       for n in SCALED_SCORERS])
    # consumed twice (confusion counts and AUC): keep it instead of re-running the split
    return sc.label_scores(test.select("row_id", "label", F.inline(models))).persist(StorageLevel.MEMORY_AND_DISK)


def _flagship_sql() -> str:
    zs = " UNION ALL ".join(
        f"SELECT row_id, '{n}' AS model, label, {squash_sql(_zscore_logit_sql(n))} AS score "
        f"FROM scaled WHERE split = 'test'" for n in SCALED_SCORERS)
    return with_ctes(LINE_FEATURES_CTE.replace("line_features AS (", "_lf_raw AS (", 1),
                     "line_features AS (SELECT DISTINCT * FROM _lf_raw)", SPLIT_SQL, *_scale_sql_ctes(),
                     f"zscored AS ({zs})", f"cm AS ({_CM_SQL.format(src='zscored')})",
                     f"au AS ({_auc_sql('zscored')})", body=_report_sql("cm", "au"))


@REG.add("model_comparison", _flagship_sql())
def model_comparison(spark, d):
    t = ev.classification_table(flagship_scores(spark, d), ["model"], "label", "pred", "score")
    t = t.withColumnRenamed("auc", "roc_auc")
    return finish(t.select("model", "accuracy", "precision", "recall", "f1", "roc_auc", "tn", "fp", "fn", "tp")
                  .orderBy(F.col("recall").desc(), "model"))


# ---- ROC / AUC over the raw-feature scorers (all rows)

def _roc_sql_ctes() -> list[str]:
    return [
        "sg AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, "
        "count(*) FILTER (WHERE label <> 1) AS neg FROM scored GROUP BY model, score)",
        "rg AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, row_number() OVER w AS idx, "
        "lead(pos) OVER (PARTITION BY model ORDER BY score DESC) AS npos, "
        "lead(neg) OVER (PARTITION BY model ORDER BY score DESC) AS nneg, "
        "count(*) OVER (PARTITION BY model) AS L, sum(pos) OVER (PARTITION BY model) AS P, "
        "sum(neg) OVER (PARTITION BY model) AS N FROM sg "
        "WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))",
        "roc AS (SELECT model, CAST(0 AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS threshold, "
        "CASE WHEN any_value(N) = 0 THEN NULL ELSE 0.0 END AS fpr, "
        "CASE WHEN any_value(P) = 0 THEN NULL ELSE 0.0 END AS tpr FROM rg GROUP BY model "
        "UNION ALL SELECT model, idx, score, CASE WHEN N = 0 THEN NULL ELSE cum_neg / N END, "
        "CASE WHEN P = 0 THEN NULL ELSE cum_pos / P END FROM rg "
        "WHERE idx = 1 OR idx = L OR L <= 2 OR pos <> npos OR neg <> nneg)",
    ]


@REG.add("roc_points", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, *_roc_sql_ctes(), body=f"""
SELECT model, idx, {r6('threshold')} AS threshold, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM roc"""))
def roc_points(spark, d):
    return finish(ev.roc_curve(b.scored(spark, d), ["model"], "label", "score"))


@REG.add("roc_nearest_grid", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, *_roc_sql_ctes(), body=f"""
SELECT model, CAST(g.i AS INTEGER) AS grid_i, {r6('g.i / 60.0')} AS grid_fpr,
       {r6('arg_min(fpr, (abs(fpr - g.i / 60.0), idx))')} AS fpr,
       {r6('arg_min(tpr, (abs(fpr - g.i / 60.0), idx))')} AS tpr
FROM roc, (SELECT range AS i FROM range(0, 61)) g WHERE fpr IS NOT NULL GROUP BY model, g.i"""))
def roc_nearest_grid(spark, d):
    roc = ev.roc_curve(b.scored(spark, d), ["model"], "label", "score")
    return finish(ev.roc_nearest_grid(roc, ["model"]))


@REG.add("auc_by_model", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, f"au AS ({_auc_sql('scored')})",
                                   body=f"SELECT model, n_pos, n_neg, {r6('auc')} AS auc FROM au"))
def auc_by_model(spark, d):
    return finish(ev.auc(b.scored(spark, d), ["model"], "label", "score"))


@REG.add("sens_spec", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, f"cm AS ({_CM_SQL.format(src='scored')})",
                                f"au AS ({_auc_sql('scored')})", body=f"""
SELECT model, tn, fp, fn, tp, {r6('CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END')} AS sensitivity,
       {r6('CASE WHEN tn + fp = 0 THEN NULL ELSE tn / (tn + fp) END')} AS specificity, {r6('auc')} AS auc
FROM cm JOIN au USING (model)"""))
def sens_spec(spark, d):
    return finish(ev.sens_spec(labelled_scores(spark, d), ["model"], "label", "pred", "score"))


@REG.add("auc_gap", with_ctes(LINE_FEATURES_CTE, SPLIT_SQL, SCORED_SQL.replace("FROM line_features", "FROM split_rows")
                              .replace("SELECT row_id, ", "SELECT row_id, split, "),
                              f"au AS ({_auc_sql('scored', 'model, split')})", body=f"""
SELECT model, {r6("any_value(auc) FILTER (WHERE split = 'train')")} AS auc_in,
       {r6("any_value(auc) FILTER (WHERE split = 'test')")} AS auc_out,
       {r6("any_value(auc) FILTER (WHERE split = 'train') - any_value(auc) FILTER (WHERE split = 'test')")} AS auc_gap
FROM au GROUP BY model"""))
def auc_gap(spark, d):
    scored = b.scored(spark, d, split_lines(spark, d), keep=["split"])
    return finish(ev.auc_gap(scored, "split", "train", "test", ["model"], "label", "score"))


@REG.add("quality_shape", with_ctes(with_missing_cte(), body="""
SELECT count(*) AS n_rows, CAST(9 AS INTEGER) AS n_cols FROM with_missing"""))
def quality_shape(spark, d):
    """Q1: rows and columns of the frame under inspection."""
    return qa.shape(b.with_missing(spark, d))


def _three_way_sql() -> str:
    second = split_cte("_rest", 0.15, f"{SEED}v", "split2")
    return with_ctes(LINE_FEATURES_CTE, SPLIT_SQL, "_rest AS (SELECT * EXCLUDE (split) FROM split_rows WHERE split = 'train')",
                     second, body="""
SELECT label, split, count(*) AS n FROM (
  SELECT label, CASE WHEN split = 'test' THEN 'val' ELSE 'train' END AS split FROM split2
  UNION ALL SELECT label, 'test' AS split FROM split_rows WHERE split = 'test')
GROUP BY label, split""")


@REG.add("three_way_split_counts", _three_way_sql())
def three_way_split_counts(spark, d):
    """20 % test, then 15 % of the rest as validation (second salt)."""
    s = sp.three_way_split(b.line_features(spark, d), "label", "row_id", TEST_FRACTION, 0.15, SEED)
    return s.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@REG.add("roc_downsample", with_ctes(LINE_FEATURES_CTE, SCORED_SQL, *_roc_sql_ctes(), """
pos AS (SELECT model, idx, fpr, tpr, row_number() OVER (PARTITION BY model ORDER BY idx) - 1 AS p,
               count(*) OVER (PARTITION BY model) AS n FROM roc)""", body=f"""
SELECT model, idx, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr FROM pos
WHERE p % greatest(1, n // 60) = 0 OR p = n - 1"""))
def roc_downsample(spark, d):
    roc = ev.roc_curve(b.scored(spark, d), ["model"], "label", "score")
    return finish(ev.roc_downsample(roc, ["model"]))


@REG.add("importance_ranking")
def importance_ranking(spark, d):
    """random-forest impurity importance of the pruned line features
    (training-dependent: rows-only)."""
    train = split_lines(spark, d).where(F.col("split") == "train")
    kept = fe.kept_columns(fe.correlation_prune(train, b.LINE_FEATURES, fe.PRUNE_THRESHOLD))
    return finish(fe.importance_ranking(train, kept, "label"), 6)
