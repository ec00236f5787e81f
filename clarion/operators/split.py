"""Deterministic stratified splitting.

Randomness is content-hash based (``md5(seed | key)``), so results do not
depend on partitioning or on task retries.  Ranking a class by that hash with
``Window.partitionBy(label)`` would put a whole class in one task; instead the
hash prefix defines 65,536 cells, per-(class, cell) counts form a small table,
and only rows of the one boundary cell per class are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clarion.session import kept

CELL_HEX_DIGITS = 4  # 16^4 = 65,536 cells


def order_key(key_col: str, seed: int | str) -> F.Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), F.col(key_col).cast("string")))


def class_quota(counts: DataFrame, label: str, fraction: float) -> DataFrame:
    """Largest-remainder allocation of ``ceil(fraction * n)`` rows over classes.

    ``counts`` is (label, n); returns (label, n, k). Integer arithmetic, ties of
    the remainder go to the smaller label.
    """
    total = F.sum("n").over(Window.partitionBy())
    with_total = counts.withColumn("_total", total)
    k_all = F.ceil(F.lit(fraction) * F.col("_total")).cast("bigint")
    # the product of two row counts outgrows a long
    share = "(CAST(_kall AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0)))"
    base = with_total.withColumn("_kall", k_all) \
        .withColumn("_floor", F.expr(f"{share} div CAST(_total AS DECIMAL(19, 0))")) \
        .withColumn("_rem", F.expr(f"{share} % CAST(_total AS DECIMAL(19, 0))"))
    left = F.col("_kall") - F.sum("_floor").over(Window.partitionBy())
    rk = F.row_number().over(Window.partitionBy().orderBy(F.col("_rem").desc(), F.col(label)))
    return base.withColumn("_left", left).withColumn("_rk", rk).select(
        label, "n", (F.col("_floor") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0)).alias("k"))


def _with_cells(df: DataFrame, key_col: str, seed) -> DataFrame:
    h = order_key(key_col, seed)
    return df.withColumn("_h", h).withColumn(
        "_cell", F.conv(F.substring("_h", 1, CELL_HEX_DIGITS), 16, 10).cast("int"))


def _cell_offsets(cells: DataFrame, label: str) -> DataFrame:
    """(label, _cell, _cnt, _before): rows of the class in earlier cells."""
    cc = cells.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return cc.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))


def stratified_split(df: DataFrame, label: str = "label", key_col: str = "row_id",
                     test_fraction: float = 0.2, seed: int = 42, split_col: str = "split") -> DataFrame:
    """Adds ``split`` in {'train','test'}; exact per-class test counts.

    The rows are written with their cell: the counts, the rows of plain cells and
    those of boundary cells read them, and every later reader of the split does."""
    cells = kept(_with_cells(df, key_col, seed).drop("_h"), "split-cells")
    offsets = _cell_offsets(cells, label)
    quota = class_quota(offsets.groupBy(label).agg(F.sum("_cnt").alias("n")), label, test_fraction)
    # (classes x 65,536) rows at most: bounded independent of the data size.
    marks = offsets.join(F.broadcast(quota.select(label, "k")), label).select(
        label, "_cell", "_before",
        F.when(F.col("_before") + F.col("_cnt") <= F.col("k"), F.lit("test"))
         .when(F.col("_before") >= F.col("k"), F.lit("train"))
         .otherwise(F.lit("boundary")).alias("_state"), "k")
    marked = cells.join(F.broadcast(marks), [label, "_cell"])
    plain = marked.where(F.col("_state") != "boundary").withColumn(split_col, F.col("_state"))
    edge = marked.where(F.col("_state") == "boundary").withColumn("_h", order_key(key_col, seed))
    rn = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_h"))
    edge = edge.withColumn(split_col, F.when(F.col("_before") + rn <= F.col("k"), "test").otherwise("train"))
    out_cols = [*df.columns, split_col]
    return plain.select(*out_cols).unionByName(edge.select(*out_cols))


def three_way_split(df: DataFrame, label: str = "label", key_col: str = "row_id",
                    test_fraction: float = 0.2, val_fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """Test first, then a validation share of the remaining rows."""
    # read twice (the rest is split again, the test part is kept): keep it once
    first = kept(stratified_split(df, label, key_col, test_fraction, seed, "_s1"), "split")
    rest = first.where(F.col("_s1") == "train").drop("_s1")
    second = stratified_split(rest, label, key_col, val_fraction, f"{seed}v", "split")
    second = second.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    test = first.where(F.col("_s1") == "test").drop("_s1").withColumn("split", F.lit("test"))
    return second.unionByName(test)


def stratified_folds(df: DataFrame, label: str = "label", key_col: str = "row_id",
                     k: int = 5, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """fold = (rank within class by hash) mod k -- every class spread evenly.

    The rank is (rows of the class in earlier cells) + (rank inside the cell),
    so the window runs per (class, cell), never per class.
    """
    cells = _with_cells(df, key_col, seed)
    offsets = _cell_offsets(cells, label).select(label, "_cell", "_before")
    rn = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_h"))
    ranked = cells.join(F.broadcast(offsets), [label, "_cell"]).withColumn("_rank", F.col("_before") + rn - 1)
    return ranked.select(*df.columns, (F.col("_rank") % k).cast("int").alias(fold_col))


def capped_sample(df: DataFrame, n: int, key_col: str, seed: int = 42) -> DataFrame:
    """T4/T5: the first ``n`` rows by content hash (a bounded background set).
    ``n`` is the feature here (a sampling operator), not a cost cap."""
    return df.withColumn("_h", order_key(key_col, seed)).orderBy("_h").limit(n).drop("_h")
