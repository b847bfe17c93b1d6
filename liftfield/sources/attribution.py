"""Multi-touch attribution exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.functions.scalars import channel_key, zero_if_undefined
from liftfield.sources.landed import number

VALID_WINDOWS = (1, 7, 14, 28, 30, 90)


def check_window(days: int) -> int:
    if days not in VALID_WINDOWS:
        raise ValueError(f"attribution window {days} is not one of {VALID_WINDOWS}")
    return days


def channel_attribution(raw: DataFrame, window_days: int = 28) -> DataFrame:
    """Attributed revenue and conversions per day and canonical channel key."""
    check_window(window_days)
    return raw.select(
        F.to_date("date").alias("date"),
        channel_key(F.col("channel")).alias("channel"),
        number("attributed_revenue").alias("attributed_revenue"),
        number("attributed_conversions").alias("attributed_conversions"),
        F.lit(window_days).cast("bigint").alias("attribution_window"),
    )


def new_returning_split(raw: DataFrame) -> DataFrame:
    """New and returning revenue with the new share (0 when there is no revenue)."""
    rows = raw.select(
        F.to_date("date").alias("date"),
        channel_key(F.col("channel")).alias("channel"),
        number("new_revenue").alias("new_revenue"),
        number("returning_revenue").alias("returning_revenue"),
    )
    total = F.col("new_revenue") + F.col("returning_revenue")
    return rows.withColumn("new_pct", zero_if_undefined(F.col("new_revenue"), total))
