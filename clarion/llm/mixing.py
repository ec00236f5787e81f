"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words.  Sources, in code-point order with
null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` times all words; a
source's target stops at ``MOST`` times its words, and the excess is shared
anew by weight until no target is above (the level ``l`` with
``sum(min(most, l * weight)) = total`` in closed form over the sorted sources).

Every document of a source expects ``target / source size`` copies.  Inside a
source documents stand in order of size (then by a hash of the doc_id), so each
stretch of the list holds documents of about one size; the expected copies are
prefix-summed, one random offset per source is added, and a document is emitted
once per integer boundary crossed: 0, 1 or 2 times, never more than ``MOST``.
The offset comes from a hash of the source and the seed, so reruns agree.

Only narrow rows (source, size, doc_id) are ranked, over range partitions that
cut through a hot source; no window spans a source.  Sources without words
have target 0.  Rows that repeat a document stand next to each other and may
get different copies; a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarion.llm.common import ranked, word_count

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2, 7


def unit(text: Column) -> Column:
    """A number in [0, 1) from the text's hash."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` (double) for each row of ``sources`` (source, source_size); one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_ = Window.partitionBy()
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    level = left / F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (rows.withColumn("level", level).withColumn("level", F.max("level").over(all_))
            .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies for every row of ``docs`` (doc_id, text, source)."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    rows, _ = ranked(sized, ["source", "size", "_h"], [], "mix-order")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("row_no").alias("first"))
    share_of = targets(sources.select("source", "source_size"), weights, share, most)
    # one row per source, far fewer than documents; the planner broadcasts it only under its size limit
    per = sources.select("source", "first").join(share_of.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    per = per.select(F.col("source").alias("_s"), "first", "source_size", "target",
                     F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("each"),
                     unit(F.concat_ws("|", F.lit(str(seed)), F.lit("offset"), F.coalesce("source", F.lit("")))).alias("offset"))
    joined = rows.join(per, F.col("source").eqNullSafe(F.col("_s")))
    rank = (F.col("row_no") - F.col("first")).cast("double")
    edge = lambda r: F.floor(r * F.col("each") + F.col("offset"))
    return joined.select("doc_id", "source", "size", "source_size", "target", (edge(rank + 1) - edge(rank)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = plan(docs, weights, share, most, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_all > 0")
    # the document travels as one column, so its names clash with none of these
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), word_count(F.col("text")).alias("words"))
    taken = taken.withColumnRenamed("source", "from")
    same = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & F.col("doc.source").eqNullSafe(F.col("from")) & (F.col("words") == F.col("size"))
    one = sized.join(taken.where("_rows = 1"), same).withColumn("times", F.col("_all"))
    # repeated rows share their copies, in order of what they hold
    again = sized.join(taken.where("_rows > 1"), same)
    turn = F.row_number().over(Window.partitionBy("doc_id", "from", "size").orderBy(F.xxhash64("doc.text"), F.xxhash64("doc")))
    again = again.withColumn("times", F.floor(F.col("_all") / F.col("_rows")) + F.when(turn <= F.col("_all") % F.col("_rows"), 1).otherwise(0))
    return one.unionByName(again).select("doc", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("doc.*")
