"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clarion.session import ensure_checkpoint_dir

#: A word: a run without space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: The word shingles' default length and the default similarity of near-duplicate operators.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have (any letter case)."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Shuffle files go as soon as the query that made them has ended, not when the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str, clean: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder and read it back.

    Cuts the lineage; a lost executor costs only its running tasks.  Every call
    takes a folder of its own, so reruns and concurrent jobs do not meet.
    ``clean``: the shuffle files behind ``df`` are deleted once it is written, for
    frames that nothing else reads.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    if clean:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], sums: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """Global positions without a global window.

    Rows are range-partitioned by ``order`` (finish it with enough columns that
    one hot value does not fill a partition), written with their partition
    number, and totals per partition are prefix-summed (one row per partition).
    Returns the rows plus ``row_no`` (0, 1, ...) and ``before_<c>`` (sum of
    ``c`` over earlier rows) for each column of ``sums``, and one row of totals:
    ``rows`` and ``total_<c>``.
    """
    from pyspark.sql import Window

    parted = stored(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id()), tag)
    totals = parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    zero = F.lit(0).cast("long")
    starts = totals.select("_pid", F.coalesce(F.sum("_n").over(earlier), zero).alias("_n0"),
                           *[F.coalesce(F.sum(f"_s_{c}").over(earlier), zero).alias(f"_s0_{c}") for c in sums])
    within = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(starts, "_pid").select(
        *df.columns,
        (F.col("_n0") + F.count(F.lit(1)).over(within)).alias("row_no"),
        *[(F.col(f"_s0_{c}") + F.coalesce(F.sum(c).over(within), zero)).alias(f"before_{c}") for c in sums])
    return out, totals.agg(F.coalesce(F.sum("_n"), zero).alias("rows"),
                           *[F.coalesce(F.sum(f"_s_{c}"), zero).alias(f"total_{c}") for c in sums])


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0), without building the words."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def tidy() -> None:
    """Give memory that a worker no longer uses back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of the column ``text``, so that few texts are Python objects at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        done, at = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(done, (done[at - 1] if at else 0) + most, side="right"))
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    tidy()
