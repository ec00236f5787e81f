"""Reconstruction-error anomaly detector (M12), re-aimed as a linear
autoencoder: PCA with k components fitted on the normal (benign) rows only.

error(x) = mean_i (x_i - x_hat_i)^2 with x_hat = mu + P P^T (x - mu).  The
components are orthonormal, so with c = x - mu the error is
(|c|^2 - |P^T c|^2) / d: two norms of a row, one projection by MLlib's matrix
product.  Rows are scored once; the threshold is the exact 95th percentile
(linear interpolation) of the *training normal* errors among them; a row is
anomalous when its error is above the threshold (strict).
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarion.functions.stats import exact_percentiles
from clarion.session import kept

BOTTLENECK = 8
PERCENTILE = 0.95


def _square(vector: Column) -> Column:
    return F.aggregate(vector_to_array(vector), F.lit(0.0), lambda acc, x: acc + x * x)


def reconstruction_errors(normal: DataFrame, df: DataFrame, vec_col: str, k: int = BOTTLENECK, out: str = "error") -> DataFrame:
    """``df`` with the error of each row against ``k`` components fitted on the rows of ``normal``."""
    d = len(normal.select(vec_col).first()[0])
    as_vectors = lambda rows: rows.withColumn("_x", array_to_vector(vec_col))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_x", outputCol="_c").fit(as_vectors(normal))
    parts = PCA(k=min(k, d), inputCol="_c", outputCol="_p").fit(centre.transform(as_vectors(normal)))
    scored = parts.transform(centre.transform(as_vectors(df)))
    return scored.withColumn(out, F.greatest(_square(F.col("_c")) - _square(F.col("_p")), F.lit(0.0)) / d).drop("_x", "_c", "_p")


def anomaly_scores(df: DataFrame, id_col: str, vec_col: str, normal: Column, k: int = BOTTLENECK, q: float = PERCENTILE) -> DataFrame:
    """(id, error, threshold, is_anomaly); ``normal`` is true for the training rows of the normal class."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"), normal.alias("_n"))
    scored = kept(reconstruction_errors(rows.where("_n"), rows, "_v", k).select("id", "_n", "error"), "errors")
    limit = exact_percentiles(scored.where("_n"), "error", [q]).select(F.col("value").alias("threshold"))  # one row
    return scored.drop("_n").crossJoin(F.broadcast(limit)).withColumn("is_anomaly", F.col("error") > F.col("threshold"))
