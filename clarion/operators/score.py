"""Batch scoring (X1-X3), scored-row reports (K3) and provenance flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarion.functions.columns import (
    DEFAULT_THRESHOLD, half_even, risk_tier, threshold_class, threshold_label)


def select_family(df: DataFrame, family: str | Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """The columns of a family, in table order, and ``extra`` behind them.

    A string is a suffix (``mean`` takes every column that ends in ``_mean``), a
    sequence names the columns; nothing chosen is an error, as is a name that
    the table does not have.
    """
    if isinstance(family, str):
        chosen = [c for c in df.columns if c.endswith(f"_{family}")]
    else:
        chosen = [c for c in df.columns if c in set(family)]
        if absent := sorted(set(family) - set(chosen)):
            raise ValueError(f"no such columns: {', '.join(absent)}")
    if not chosen:
        raise ValueError(f"no column of the family {family!r}")
    return df.select(*chosen, *[c for c in extra if c not in chosen])


def label_scores(df: DataFrame, score: str = "score", threshold: float = DEFAULT_THRESHOLD,
                 strict: bool = False, digits: int = 4) -> DataFrame:
    """Predicted class and risk tier from the raw probability; the
    reported probability is rounded (``digits``) only for display."""
    return df.select("*",
                     threshold_class(score, threshold, strict).alias("predicted_class"),
                     threshold_label(score, threshold, strict).alias("pred"),
                     half_even(score, digits).alias("probability_malignant"),
                     risk_tier(score).alias("risk_tier"))


def batch_summary(scored: DataFrame, group_cols: Sequence[str] = ("model",)) -> DataFrame:
    """n_rows, n_malignant, n_benign per group."""
    return scored.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("predicted_class") == "Malignant").alias("n_malignant"),
        F.count_if(F.col("predicted_class") == "Benign").alias("n_benign"))


def score_with_model(model, df: DataFrame, prob_col: str = "probability", model_name: str | None = None,
                     model_source: str = "trained", is_demo: bool = False) -> DataFrame:
    """X1 for any fitted MLlib model/pipeline: class-1 probability as ``score``
    plus provenance columns that are never dropped (P9)."""
    out = model.transform(df)
    out = out.withColumn("score", vector_to_array(F.col(prob_col)).getItem(1))
    if model_name is not None:
        out = out.withColumn("model", F.lit(model_name))
    return label_scores(out.withColumn("model_source", F.lit(model_source)).withColumn("is_demo", F.lit(is_demo)))


def scored_report(df: DataFrame, input_source: str, ts_col: str | None = None) -> DataFrame:
    """K3: timestamp, input_source, predicted_class, probability_malignant,
    warning (only for rows produced by a demo model, NULL otherwise)."""
    ts = F.col(ts_col) if ts_col else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    warn = F.when(F.col("is_demo"), F.lit("Demo model output - not clinically meaningful"))
    return df.select(ts.alias("timestamp"), F.lit(input_source).alias("input_source"),
                     "predicted_class", half_even("score", 4).alias("probability_malignant"),
                     warn.alias("warning"))
