"""Data quality and cleaning (Q1-Q10).

All statistics of a frame are computed in one aggregation pass where possible
(one ``agg`` with one expression per column), never one job per column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarion.functions.columns import half_even
from clarion.functions.stats import exact_percentiles, unpivot_values


def _is_missing(df: DataFrame, c: str) -> F.Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def shape(df: DataFrame) -> DataFrame:
    """Q1: one row (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q2: (column, n_missing) for columns with at least one NULL/NaN, one pass."""
    cols = list(columns or df.columns)
    counts = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in cols])
    return (counts.unpivot([], cols, "column", "n_missing")
            .where(F.col("n_missing") > 0))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Q3: rows beyond the first of every identical group (all columns)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_cnt"))
    return groups.agg(F.sum("_cnt").alias("n_rows"),
                      F.sum(F.col("_cnt") - 1).alias("n_duplicates"),
                      F.count(F.lit(1)).alias("n_distinct")).withColumn("n_cols", F.lit(len(df.columns)))


def class_balance(df: DataFrame, label: str = "label", digits: int | None = None) -> DataFrame:
    """Q4/Q8/A1: (label, n, share). The grouped table has one row per class, so
    the total is a window over that tiny table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    if digits is not None:
        share = half_even(share, digits)
    return counts.withColumn("share", share)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Q5: keep one copy of identical rows (all columns incl. the label)."""
    return df.dropDuplicates()


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q7/A3: exact medians as a long table (column, median)."""
    long_df = unpivot_values(df, columns)
    return exact_percentiles(long_df, "x", [0.5], ["column"]).select("column", F.col("value").alias("median"))


def impute_median(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Q6: fill NULL/NaN with the exact column median over all rows.

    Medians form a one-row table (bounded by the number of columns) that is
    broadcast to every task; returns (filled frame, medians long table).
    """
    med_long = column_medians(df, columns)
    med_row = med_long.groupBy().pivot("column", list(columns)).agg(F.first("median"))
    med_row = med_row.select(*[F.col(c).alias(f"_med_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(med_row)).select(
        *[F.when(_is_missing(df, c), F.col(f"_med_{c}")).otherwise(F.col(c)).alias(c)
          if c in columns else F.col(c) for c in df.columns])
    return filled, med_long


def _pair_moments(d: int):
    """Per task the counts, means and centred squares and products of the rows that have both columns of a pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, d, d))  # n, mean of x, mean of y, xx, yy, xy
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float)
            there = ~np.isnan(x)
            m = there.astype(float)
            if not len(x):
                continue
            # around a value first: what does not vary is exactly 0 then
            shift = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(d)], 0.0)
            x = np.where(there, x - shift, 0.0)
            middle = x.sum(axis=0) / np.maximum(m.sum(axis=0), 1)
            x, shift = np.where(there, x - middle, 0.0), shift + middle
            n, sx, sy = m.T @ m, x.T @ m, m.T @ x
            mx, my = sx / np.maximum(n, 1), sy / np.maximum(n, 1)
            held = _merged(held, np.stack([n, mx + shift[:, None], my + shift, (x * x).T @ m - sx * mx, m.T @ (x * x) - sy * my, x.T @ x - sx * my]))
        i, j = np.triu_indices(d, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(s[i, j]) for s in held]], names=["i", "j", *_MOMENTS])
    return run


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy = b[1] - a[1], b[2] - a[2]
    apart = a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * apart, a[4] + b[4] + dy * dy * apart, a[5] + b[5] + dx * dy * apart])


_MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def correlation_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q9/A5: Pearson's r of every pair i < j as (col_i, col_j, r), over the rows that have both values.

    One pass of masked co-moments (n, means, centred squares and products per pair),
    merged over the batches of a task and over the tasks; NULL where fewer than two rows
    have both or a column does not vary there.
    """
    cols = list(columns)
    plain = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    parts = plain.mapInArrow(_pair_moments(len(cols)), "i int, j int, " + ", ".join(f"{s} double" for s in _MOMENTS))
    # a row per pair and task: centred anew around the means of all
    w = Window.partitionBy("i", "j")
    parts = parts.where("n > 0").withColumns({f"d{c}": F.col(c) - F.min(c).over(w) for c in "xy"})
    parts = parts.withColumns({f"d{c}": F.col(f"d{c}") - F.sum(F.col("n") * F.col(f"d{c}")).over(w) / F.sum("n").over(w) for c in "xy"})
    total = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), *[F.sum(F.col(a + c) + F.col("n") * F.col(f"d{a}") * F.col(f"d{c}")).alias(a + c) for a, c in ("xx", "yy", "xy")])
    pairs = df.sparkSession.createDataFrame([(i, j) for j in range(len(cols)) for i in range(j)], "i int, j int")
    # least and greatest pass NULL over, so they stand inside
    r = F.when((F.col("n") >= 2) & (F.col("xx") > 0) & (F.col("yy") > 0), F.greatest(F.least(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), F.lit(1.0)), F.lit(-1.0)))
    names = F.array(*[F.lit(c) for c in cols])
    return pairs.join(total, ["i", "j"], "left").select(names[F.col("i")].alias("col_i"), names[F.col("j")].alias("col_j"), r.alias("r"))


def box_summary(df: DataFrame, columns: Sequence[str], label: str = "label", whis: float = 1.5) -> DataFrame:
    """Q10: per (label, feature) quartiles, 1.5 IQR whiskers and outlier count.

    Whiskers are the most extreme data points inside the fences, outliers are
    the points outside them (the usual box-plot definition).
    """
    long_df = unpivot_values(df, columns, [label], "feature", "x").where(
        F.col("x").isNotNull() & ~F.isnan("x"))
    q = exact_percentiles(long_df, "x", [0.25, 0.5, 0.75], [label, "feature"])
    qw = (q.groupBy(label, "feature").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
          .toDF(label, "feature", "q1", "median", "q3"))
    fences = qw.withColumn("_lo", F.col("q1") - whis * (F.col("q3") - F.col("q1"))) \
               .withColumn("_hi", F.col("q3") + whis * (F.col("q3") - F.col("q1")))
    inside = (F.col("x") >= F.col("_lo")) & (F.col("x") <= F.col("_hi"))
    agg = long_df.join(fences, [label, "feature"]).groupBy(label, "feature").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return qw.join(agg, [label, "feature"])
