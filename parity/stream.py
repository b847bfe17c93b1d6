"""The incremental spend ingest, run to completion over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from liftfield.session import shared_folder
from liftfield.streaming import ingest
from parity.common import check, rounded


@check("x01_stream_ingest", """
SELECT CAST(ts AS DATE) AS date, CAST(user_id % 25 AS VARCHAR) AS geo, event_type AS channel, round(sum(value), 2) AS spend, count(*) AS n_events FROM events GROUP BY 1, 2, 3
""")
def x01(spark, sf):
    """Every event arrives twice; the totals must count it once."""
    raw = ingest.read_event_stream(
        spark, sf, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double", "events.parquet")
    twice = raw.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    events = twice.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 25).cast("string").alias("geo"),
        F.col("event_type").alias("channel"), F.col("value").alias("spend"))
    base = f"{shared_folder(spark)}/liftfield/stream-{uuid.uuid4().hex}"
    ingest.ingest_daily(events, f"{base}/raw", f"{base}/totals", f"{base}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{base}/totals"), 2)
