"""Windows of a stream: closed ones, open ones, late rows."""

import uuid

from pyspark.sql import functions as F

from clarion.streaming import score_stream as st


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "ts string, event_type string, value double").select(F.to_timestamp("ts").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(folder)


def _run(spark, folder, ckpt, out):
    agg = st.window_balance(st.read_stream(spark, folder), "ts", F.col("event_type") == "buy", "value", ["event_type"])
    rows = st.closed_and_open(agg, ["event_type"], ckpt, out).collect()
    assert len(rows) == len({(r.w, r.event_type) for r in rows})
    return {(r.w.start.strftime("%d %H"), r.event_type): (r.n, r.n_pos, r.mean_score) for r in rows}


def test_late_rows_are_dropped_and_no_window_is_missing(spark, tmp_path):
    folder, ckpt, out = (f"file://{tmp_path}/{n}-{uuid.uuid4().hex}" for n in ("in", "ckpt", "out"))
    _events(spark, folder, [("2024-01-01 10:05:00", "buy", 2.0), ("2024-01-01 10:55:00", "buy", 4.0), ("2024-01-01 10:59:00", "look", 1.0), ("2024-01-01 13:00:00", "look", 5.0)])
    first = _run(spark, folder, ckpt, out)
    assert first == {("01 10", "buy"): (2, 2, 3.0), ("01 10", "look"): (1, 0, 1.0), ("01 13", "look"): (1, 0, 5.0)}
    # the watermark stands at 12:50: the first row is too late, the second in time, the third opens a window
    _events(spark, folder, [("2024-01-01 10:10:00", "buy", 100.0), ("2024-01-01 13:20:00", "look", 7.0), ("2024-01-01 15:00:00", "buy", 9.0)])
    second = _run(spark, folder, ckpt, out)
    assert second == {("01 10", "buy"): (2, 2, 3.0), ("01 10", "look"): (1, 0, 1.0), ("01 13", "look"): (2, 0, 6.0), ("01 15", "buy"): (1, 1, 9.0)}


def test_the_event_stream_has_every_event(spark):
    from clarion.plans import stream as ps

    d = "/root/testdata/sf0.001"
    assert ps.event_window_drift(spark, d).selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{d}/events.parquet").count()
