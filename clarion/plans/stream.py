"""Registered streaming queries (EXT1, EXT2): the same results as batch,
produced by Structured Streaming over the parquet tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from clarion.operators import score as sc
from clarion.plans.common import Registry, finish
from clarion.plans.sql import LINE_FEATURES_CTE, r6, scored_cte, with_ctes
from clarion.sources import bindings as b
from clarion.streaming import score_stream as st

REG = Registry()


@REG.add("event_window_drift", f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_pos, {r6('avg(value)')} AS mean_score
FROM events GROUP BY ALL""")
def event_window_drift(spark, d):
    """EXT2: hourly tumbling windows of the events stream (10 minute watermark)."""
    ev = st.read_stream(spark, d, "events.parquet")
    agg = st.window_balance(ev, "ts", F.col("event_type") == "purchase", "value", ["event_type"])
    res = st.closed_and_open(agg)
    return finish(res.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                             "event_type", "n", "n_pos", "mean_score"))


_TIER = "CASE WHEN score < 0.35 THEN 'Low' WHEN score < 0.65 THEN 'Moderate' ELSE 'High' END"


@REG.add("stream_risk_tiers", with_ctes(LINE_FEATURES_CTE, scored_cte("line_features"), body=f"""
SELECT model, {_TIER} AS risk_tier, count(*) AS n FROM scored GROUP BY ALL"""))
def stream_risk_tiers(spark, d):
    """EXT1: lineitem files arriving as a stream, scored per micro-batch (stateless,
    parquet sink in the shared folder), then the tier counts."""
    li = st.read_stream(spark, d, "lineitem.parquet")
    scored = st.score_stream(li, lambda s: sc.label_scores(b.scored(spark, d, b._line_projection(s)))
                             .select("row_id", "model", "risk_tier"))
    rows = st.run_to_completion(scored)
    return rows.groupBy("model", "risk_tier").agg(F.count(F.lit(1)).alias("n"))
