"""Distributed statistics that stay exact without sending a group to one task.

* ``exact_percentiles`` -- linear-interpolated percentiles (numpy / DuckDB
  ``quantile_cont`` / Spark ``percentile`` definition) by radix selection.
  Spark's ``percentile`` and ``median`` keep every distinct value of a group in
  one aggregation buffer, and a window would rank a whole group.  Here values are
  seen as 64-bit integers in the same order; a pass counts them by their next
  bits and keeps, per group and rank, the one cell that holds it.  Three passes
  settle every bit, fewer when the cells hold one value each.
* ``running_totals`` -- ordered cumulative sums inside a partition key.  A
  plain ``Window.partitionBy(key).orderBy(x)`` moves a whole key to one task;
  here rows are range-partitioned by (key, x), totals per key and partition (at
  most partitions + keys rows) are prefix-summed, and the window only runs
  inside a key's share of a partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarion.session import kept

#: Bits left to settle after each pass of the selection.
SHIFTS = (43, 22, 0)


def _group_cols(group_cols) -> list[str]:
    return [group_cols] if isinstance(group_cols, str) else list(group_cols or [])


def unpivot_values(df: DataFrame, value_cols: Sequence[str], id_cols: Sequence[str] = (),
                   name_col: str = "column", value_col: str = "x") -> DataFrame:
    """Wide -> long ``(id..., column, x)`` with doubles, NULLs kept."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot(
        list(id_cols), list(value_cols), name_col, value_col)


def ordered_long(x: Column) -> Column:
    """A double as a long in the same order (its bits in IEEE 754; negative values mirrored).

    Powers of two are exact in Java's ``pow``, so division and subtraction are
    exact too.  Both zeros give 0; not defined for NaN and infinity.
    """
    two = lambda e: F.pow(F.lit(2.0), e)
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = guess + F.when(size >= two(guess + 1), 1).when(size < two(guess), -1).otherwise(0)
    normal = ((power + 1023) * (1 << 52)).cast("long") + ((size / two(power) - 1) * float(1 << 52)).cast("long")
    small = (size * float(2 ** 537) * float(2 ** 537)).cast("long")
    image = F.when(size < 2.0 ** -1022, small).otherwise(normal)
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 0, -image).otherwise(image)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULLs equal; the keys of ``a`` stay."""
    if not keys:
        return a.join(b, how=how)
    right = b.withColumnsRenamed({k: f"{k}__right" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__right")) for k in keys])
    return a.join(right, on, how).drop(*[f"{k}__right" for k in keys])


def exact_percentiles(long_df: DataFrame, value_col: str, probs: Sequence[float],
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated percentiles of ``value_col`` per group.

    Returns ``(group..., p, value)``.  NULL and NaN values are ignored,
    infinities are not supported; a group with no values yields no rows.  The
    input is read once per pass; between passes only one row per group,
    percentile and neighbouring rank is kept.
    """
    g = _group_cols(group_cols)
    x = F.col("_x")
    data = long_df.select(*g, F.col(value_col).cast("double").alias("_x")).where(x.isNotNull() & ~F.isnan(x)).withColumn("_k", ordered_long(x))
    counted = [F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]

    def placed(cells: DataFrame, keys: list[str]) -> DataFrame:
        """Cells with the number of values in earlier cells of the same key."""
        order = Window.partitionBy(*keys).orderBy("_cell")
        return cells.withColumn("_before", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))

    first = placed(data.groupBy(*g, F.shiftright("_k", SHIFTS[0]).alias("_cell")).agg(*counted), g)
    first = first.withColumn("_n", F.sum("_c").over(Window.partitionBy(*g)))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(up).alias("up"), (F.ceil if up else F.floor)((F.col("_n") - 1) * float(p)).alias("rank"))
                      for p in probs for up in (False, True)])
    here = first.select("*", F.explode(ranks).alias("t")).select(*first.columns, "t.*").where("rank >= _before AND rank < _before + _c")
    here = kept(here.select(*g, "p", "up", "_n", "_cell", "_lo", "_hi", (F.col("rank") - F.col("_before")).alias("rank")), "percentile")
    for shift, before in zip(SHIFTS[1:], SHIFTS):
        open_ = here.where("_lo < _hi")
        if open_.isEmpty():
            break
        cells = open_.select(*g, F.col("_cell").alias("_from")).distinct()
        inside = same_keys(data.withColumn("_from", F.shiftright("_k", before)), cells, [*g, "_from"])
        finer = placed(inside.groupBy(*g, "_from", F.shiftright("_k", shift).alias("_cell")).agg(*counted), [*g, "_from"])
        found = same_keys(finer, open_.select(*g, "p", "up", "_n", F.col("_cell").alias("_from"), "rank"), [*g, "_from"]).where("rank >= _before AND rank < _before + _c")
        found = found.select(*g, "p", "up", "_n", "_cell", "_lo", "_hi", (F.col("rank") - F.col("_before")).alias("rank"))
        here = kept(here.where("_lo = _hi").unionByName(found), "percentile")
    ends = here.groupBy(*g, "p").agg(F.max("_n").alias("_n"), F.max(F.when(~F.col("up"), F.col("_lo"))).alias("_a"), F.max(F.when(F.col("up"), F.col("_lo"))).alias("_b"))
    at = (F.col("_n") - 1) * F.col("p")
    return ends.select(*g, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias("value"))


def exact_percentiles_wide(df: DataFrame, value_cols: Sequence[str], p: float,
                           group_cols: Sequence[str] = ()) -> DataFrame:
    """One percentile of several columns: ``(group..., column, value)``."""
    g = _group_cols(group_cols)
    long_df = unpivot_values(df, value_cols, g)
    return exact_percentiles(long_df, "x", [p], [*g, "column"]).drop("p")


def running_totals(df: DataFrame, key_cols: Sequence[str], order_col: str, value_cols: Sequence[str],
                   descending: bool = True, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``value_cols`` over ``order_col`` within ``key_cols``.

    ``(key, order_col)`` should be unique (aggregate first).  Adds
    ``{prefix}{v}`` for each value column.  NULL order values come last.
    """
    keys = _group_cols(key_cols)
    order = F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_last()
    parted = kept(df.repartitionByRange(*[F.col(k) for k in keys], order).withColumn("_part", F.spark_partition_id()), "running")
    totals = parted.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    offsets = kept(offsets, "running-offsets")  # written so that Spark knows how small it is
    within = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = same_keys(parted, offsets, [*keys, "_part"])
    return out.select(*df.columns, *[(F.col(f"_o_{v}") + F.sum(v).over(within)).alias(f"{prefix}{v}") for v in value_cols])
