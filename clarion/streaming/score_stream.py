"""Structured Streaming additions (not reference behaviour; marked EXT).

* EXT1 ``score_stream``: score a directory of arriving files with the fixed
  scorers / any column expression, stateless, written to a parquet sink.
* EXT2 ``window_balance``: tumbling-window class balance and score drift with
  a watermark; rows later than the watermark are dropped by Spark (append mode).

Checkpoints and file sinks live under the shared folder named by
``spark.checkpoint.dir`` so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarion.session import ensure_checkpoint_dir

WATERMARK = "10 minutes"
WINDOW = "1 hour"


def _scratch(spark: SparkSession, kind: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stream-{kind}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, directory: str, file_glob: str = "*.parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream over ``directory`` (files matching ``file_glob``),
    with the schema taken from the files already there."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(directory).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def window_balance(events: DataFrame, ts: str = "ts", label_expr=None, score: str = "value",
                   group_cols=("event_type",), watermark: str = WATERMARK, window: str = WINDOW) -> DataFrame:
    """EXT2: per tumbling window (and group): rows, positives, mean score."""
    lab = label_expr if label_expr is not None else F.lit(0)
    # watermarks need TIMESTAMP (not TIMESTAMP_NTZ); in a UTC session the cast keeps wall-clock time
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (events.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), *group_cols)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(lab.cast("long")).alias("n_pos"),
                 F.avg(score).alias("mean_score")))


def run_to_completion(sdf: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Drive a streaming frame over everything available in append mode and read back the Parquet files.

    ``checkpoint`` and ``out`` (both or none) let a later run go on where this one stopped."""
    ckpt, out = checkpoint or _scratch(sdf.sparkSession, "ckpt"), out or _scratch(sdf.sparkSession, "out")
    q = sdf.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt).start()
    q.processAllAvailable()
    q.stop()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(out)


def closed_and_open(sdf: DataFrame, groups: Sequence[str] = ("event_type",), checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """EXT2: the windows of ``window_balance`` that the watermark has closed, and those that are still open.

    Closed windows are written once, in append mode, and rows that come later
    than the watermark are dropped.  Open ones stand in the state store and are
    read from there, so no window is missing and none is written twice.
    """
    spark = sdf.sparkSession
    ckpt, out = checkpoint or _scratch(spark, "ckpt"), out or _scratch(spark, "out")
    closed = run_to_completion(sdf, ckpt, out)
    state = spark.read.format("statestore").load(ckpt)
    # what the three aggregates keep: rows, positives, and the score's sum and number (by place: names repeat)
    flat = state.select("key", F.col("value").cast("struct<n: long, n_pos: long, s: double, c: long>").alias("v")).select("key.*", "v.*").toDF("w", *groups, "n", "n_pos", "s", "c")
    return closed.unionByName(flat.select("w", *groups, "n", "n_pos", (F.col("s") / F.col("c")).alias("mean_score")))


def score_stream(stream: DataFrame, project) -> DataFrame:
    """EXT1: a stateless projection (``project``: DataFrame -> DataFrame) applied
    to every micro-batch."""
    return project(stream)
