"""Contiguous shards of nearly equal bytes.

Documents stand in the order of their text's hash, then doc_id: a shuffled
order in which equal texts are neighbours.  The rows are range-partitioned in
that order; totals per partition are prefix-summed, each row's byte offset is
its partition's start plus a running sum inside the partition, and the order is
cut at equal byte targets (a row belongs where its middle byte falls).  Each
shard is contiguous, and its bytes differ from the target by at most the size
of a document at either cut.  Range keys include the doc_id, so a text that
fills a third of the table is spread over partitions (and, as it must, shards).

A row counts its text's UTF-8 bytes plus 1, so null and empty texts and rows of
repeated documents are placed like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarion.llm.common import fresh, ranked

SHARDS = 16


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, _h and what else is carried) plus ``shard``, ``slot`` and ``row_no``."""
    placed, totals = ranked(rows, ["_h", "text_crc32", "doc_id", "size"], ["size"], "shard-order")
    total = F.lit(max(1, totals.first()["total_size"]))
    # the middle of the row in halves of bytes, in wide integers
    middle = (F.lit(2) * F.col("before_size") + F.col("size")).cast("decimal(30,0)")
    cut = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / (F.lit(2) * total)).cast("int")))
    first = cut.groupBy("shard").agg(F.min("row_no").alias("_first"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").withColumn("slot", (F.col("row_no") - F.col("_first")).cast("long"))


def _measured(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_h")]


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", *_measured(F.col("text")))
    return _placed(rows, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write every row of ``docs`` under ``path``, one folder ``shard=N`` per shard.

    Whole rows are placed, so repeated doc_ids and rows stay what they are.  A
    shard's files are written by the tasks that hold its part of the order, each
    in order of the slots.  Where ``docs`` has a column ``shard`` the folders take
    the next free name.
    """
    folder = "shard" if "shard" not in {c.lower() for c in docs.columns} else fresh(docs, "shard")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", *_measured(F.col("text")))
    out = _placed(rows, shards).repartitionByRange("row_no").sortWithinPartitions("row_no")
    out.select("doc.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
