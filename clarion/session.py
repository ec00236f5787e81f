"""Spark session and checkpoint-folder helpers.

On a cluster the session is created by the platform; these helpers only fill in
settings that are missing, so the same code runs in tests on ``local[*]`` and on
a cluster without hard-coding any machine-local path there.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a local run needs; on a cluster the launcher's values win.
_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is provably small; operators that broadcast check size
    # themselves, the automatic threshold stays at a conservative value.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "clarion",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("CLARION_MASTER", "local[*]"))
    conf = dict(_LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.cpu_count() or 8)
    conf["spark.driver.memory"] = os.environ.get("CLARION_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used as is.  When nothing is configured, a
    session on ``local[...]`` (tests) gets a fresh folder under the system temp
    dir; elsewhere that would be a different folder on every machine, so it is
    an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
        current = sc._jsc.sc().getCheckpointDir()
    except Exception:  # noqa: BLE001 - no SparkContext handle (Spark Connect): use the conf as is
        sc, current = None, None
    if current is not None and current.isDefined():
        return current.get()
    if not conf_dir:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="clarion-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df, tag: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``cut_lineage`` and leaves statistics of its size, so
    that Spark can broadcast what is small.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
