"""Percentiles by radix selection and running totals over range partitions."""

import random
import struct

import numpy as np
from pyspark.sql import functions as F

from clarion.functions import stats


def test_ordered_long_is_the_bit_pattern(spark):
    rng = random.Random(1)
    xs = [0.0, 1.0, 2.0, 0.5, 3.0, 1e308, 5e-324, 2.0 ** -1022, 2.0 ** -1023 * 1.5, 4.0 - 2.0 ** -51, 1.7976931348623157e308, 0.1, 1 / 3]
    xs += [rng.uniform(1, 2) * 2.0 ** rng.randrange(-1021, 1023) for _ in range(300)] + [np.nextafter(2.0 ** k, s) for k in range(-40, 40, 7) for s in (0, np.inf)]
    xs = [float(x) for x in xs] + [-float(x) for x in xs]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.ordered_long(F.col("x")).alias("k")).collect()
    for r in got:
        bits = struct.unpack(">q", struct.pack(">d", abs(r.x)))[0]
        assert r.k == (bits if r.x > 0 else -bits), r.x


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(0, 1e-3, 500), "wide": rng.uniform(-1, 1, 300) * 10.0 ** rng.integers(-200, 200, 300), "equal": np.full(700, 2.5), "close": 1 + rng.integers(0, 5, 400) * 2.0 ** -52,
              "one": np.array([-7.0]), "two": np.array([-0.0, 3.0]), None: np.arange(10.0)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("normal", None), ("normal", float("nan")), ("empty", None)]
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    out = stats.exact_percentiles(spark.createDataFrame(rows, "g string, x double"), "x", probs, ["g"]).collect()
    assert len(out) == len(groups) * len(probs)
    for r in out:
        want = np.percentile(groups[r.g], r.p * 100)
        assert r.value == want or abs(r.value - want) <= 1e-12 * abs(want), (r, want)
    whole = stats.exact_percentiles(spark.range(101).select(F.col("id").cast("double").alias("x")), "x", [0.5]).first()
    assert whole.value == 50.0


def test_running_totals_spread_one_model(spark):
    rng = random.Random(3)
    rows = [("narrow", 0.5 + i * 1e-12, 1) for i in range(2_000)] + [("wide", float(i), 2) for i in range(50)] + [(None, 1.0, 5), (None, None, 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "m string, s double, v long")
    out = stats.running_totals(df, ["m"], "s", ["v"]).collect()
    for m in ("narrow", "wide", None):
        total = 0
        for r in sorted((r for r in out if r.m == m), key=lambda r: (r.s is None, -(r.s or 0))):
            total += r.v
            assert r.cum_v == total
    # a model whose scores lie close together is cut by its own scores
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = df.where("m = 'narrow'").repartitionByRange(8, "m", "s").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) == 8 and max(r["count"] for r in parts) < 1_000
