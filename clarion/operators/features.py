"""Feature engineering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarion.operators.forest import importances
from clarion.operators.quality import correlation_long
from clarion.session import kept

PRUNE_THRESHOLD = 0.95


def scaler_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F1 fit: one row of mean and *population* std per column (ddof = 0)."""
    return train.agg(*[e for c in columns for e in
                       (F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"))])


def apply_scaler(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F1 transform: (x - mean) / std; a zero std divides by 1 (constant -> 0).
    ``stats`` is one row, broadcast to every task."""
    joined = df.crossJoin(F.broadcast(stats))
    out = []
    for c in df.columns:
        if c in columns:
            sd = F.col(f"_sd_{c}")
            out.append(((F.col(c) - F.col(f"_mu_{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def standard_scale(train: DataFrame, columns: Sequence[str], *others: DataFrame):
    """Fit on ``train``, apply to train and every other frame."""
    stats = scaler_stats(train, columns)
    return (apply_scaler(train, stats, columns), *[apply_scaler(o, stats, columns) for o in others])


def correlation_prune(df: DataFrame, columns: Sequence[str], threshold: float = PRUNE_THRESHOLD) -> DataFrame:
    """(position, column, kept).  Column j is dropped when any *earlier*
    column i < j has |r| > threshold -- even when i itself is dropped (this is
    what the reference computes, though its docstring says greedy)."""
    cols = list(columns)
    spark = df.sparkSession
    pos = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "position int, column string")
    pairs = correlation_long(df, cols)
    dropped = pairs.where(F.abs("r") > threshold).select(F.col("col_j").alias("column"), F.lit(False).alias("kept")).distinct()
    return pos.join(dropped, "column", "left").select("position", "column", F.coalesce("kept", F.lit(True)).alias("kept"))


def kept_columns(prune_table: DataFrame) -> list[str]:
    """Survivors in original order (a list of at most #columns names)."""
    return [r["column"] for r in prune_table.where("kept").orderBy("position").collect()]


def importance_ranking(df: DataFrame, columns: Sequence[str], label: str = "label",
                       num_trees: int = 300, seed: int = 42) -> DataFrame:
    """random-forest impurity importance, descending: (feature, importance, rank)."""
    va = VectorAssembler(inputCols=list(columns), outputCol="_features")  # refuses NULL and NaN
    y = F.col(label).cast("int")
    valid = y.isNotNull() & (y >= 0) & (y == F.col(label).cast("double"))
    rows = va.transform(df).select(vector_to_array("_features").alias("x"), F.when(valid, y).otherwise(F.raise_error(F.lit("labels are 0, 1, ..."))).alias("y"))
    imp = importances(kept(rows, "forest-rows"), len(columns), num_trees, seed)
    spark = df.sparkSession
    ranked = spark.createDataFrame(list(zip(columns, [float(v) for v in imp], range(len(columns)))),
                                   "feature string, importance double, position int")
    w = Window.orderBy(F.col("importance").desc(), "position")  # one row per feature: tiny
    return ranked.withColumn("rank", F.row_number().over(w)).drop("position")


def select_features(df: DataFrame, columns: Sequence[str], label: str = "label",
                    top_k: int | None = None, threshold: float = PRUNE_THRESHOLD) -> list[str]:
    """prune, then (only when ``top_k``) rank by importance and keep the top."""
    survivors = kept_columns(correlation_prune(df, columns, threshold))
    if not top_k:
        return survivors
    ranking = importance_ranking(df, survivors, label)
    return [r["feature"] for r in ranking.orderBy("rank").limit(top_k).collect()]


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """balanced weights n / (k * n_c): (label, n, weight)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # over one row per class
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def with_class_weights(df: DataFrame, label: str = "label", weight_col: str = "weight") -> DataFrame:
    cw = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(cw), label)  # one row per class


def pca_reduce(df: DataFrame, columns: Sequence[str], k: int = 50, out_col: str = "pca",
               id_cols: Sequence[str] = ()) -> DataFrame:
    """standardise all columns, centre, then PCA to min(k, d) dimensions."""
    cols = list(columns)
    (scaled,) = standard_scale(df, cols)
    va = VectorAssembler(inputCols=cols, outputCol="_v")
    vec = va.transform(scaled)
    k = min(k, len(cols))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    return model.transform(vec).select(*id_cols, vector_to_array("_p").alias(out_col))


def assemble_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """F8: horizontal concatenation aligned by key (inner join), not by position."""
    return left.join(right, key, "inner")
