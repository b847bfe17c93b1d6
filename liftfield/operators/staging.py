"""Typed staging views over raw tables, record rules and period predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FIRST_DAY = "2022-01-01"
SMALLEST_NET = -10000.0

# Accepted kinds of calibration test and outcome.
TEST_TYPES = ("geo_holdout", "conversion_lift", "matched_market", "ghost_ad")
OUTCOMES = ("shopify", "amazon", "combined")


def _filled(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)).alias(name)


def stage_orders(raw: DataFrame, first_day: str = FIRST_DAY) -> DataFrame:
    """Defaults filled; early days, mega-refunds and negative gross dropped."""
    return raw.filter(
        (F.col("date") >= F.lit(first_day).cast("date"))
        & (F.col("net_revenue") > SMALLEST_NET)
        & (F.col("gross_revenue") >= 0)
    ).select(
        "date", "order_id", "geo", "gross_revenue",
        _filled("discounts", 0.0), _filled("returns", 0.0), "net_revenue",
        F.coalesce(F.col("units"), F.lit(1)).cast("bigint").alias("units"),
        _filled("new_customer", False), _filled("product_category", "unknown"),
    )


def stage_marketplace(raw: DataFrame, first_day: str = FIRST_DAY) -> DataFrame:
    """The marketplace filter reads the *raw* column, so rows without one are dropped before the default applies."""
    return raw.filter(
        (F.col("date") >= F.lit(first_day).cast("date"))
        & (F.col("gross_revenue") >= 0)
        & (F.col("marketplace") == "US")
    ).select(
        "date", _filled("item", "ALL"), _filled("product_name", "unknown"), "gross_revenue",
        _filled("returns", 0.0), "net_revenue",
        F.coalesce(F.col("units"), F.lit(0)).cast("bigint").alias("units"), _filled("marketplace", "US"),
    )


def stage_spend(
    raw: DataFrame, columns: dict[str, str], channel: str | None = None, first_day: str = FIRST_DAY
) -> DataFrame:
    """Spend of one platform: cast the named columns, keep days from ``first_day``, optional constant channel."""
    out = raw.filter(F.col("date") >= F.lit(first_day).cast("date"))
    cols = [F.col("date"), F.col("geo")]
    cols.append(F.lit(channel).alias("channel") if channel else F.col("channel"))
    cols += [F.col(c).cast(kind).alias(c) for c, kind in columns.items()]
    return out.select(*cols)


SEARCH_COLUMNS = {"spend": "double", "impressions": "bigint", "clicks": "bigint", "conversions": "double", "cpc": "double"}
SOCIAL_COLUMNS = {"spend": "double", "impressions": "bigint", "reach": "bigint", "frequency": "double", "cpm": "double"}
VIDEO_COLUMNS = {"spend": "double", "impressions": "bigint", "video_views": "bigint", "clicks": "bigint", "cpv": "double"}


def route_channels(social: DataFrame, routes: dict[str, str]) -> DataFrame:
    """Rename platform channels to model channels; rows on no route drop (one pass, no self-union)."""
    target = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])[F.col("channel")]
    return social.withColumn("channel", target).filter("channel IS NOT NULL")


def test_days(tests: DataFrame) -> DataFrame:
    """One row per test and calendar day of its window, tagged pre or post."""
    first = F.date_sub("start_date", F.col("lookback_days"))
    days = tests.select("test_id", "start_date", F.explode(F.sequence(first, F.col("end_date"))).alias("date"))
    period = F.when(F.col("date") < F.col("start_date"), "pre").otherwise("post")
    return days.select("test_id", "date", period.alias("period"))


def split_periods(df: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows of each test's window, tagged pre ([start − lookback, start − 1]) or post ([start, end]).

    Windows become day rows, so this is a hash join on the date and does no more work than its output.
    """
    return df.join(test_days(tests), "date").select("test_id", *df.columns, "period")


def scope_revenue(df: DataFrame, scope: str) -> DataFrame:
    """Pick the revenue column the measurement scope names."""
    source = {"store_only": "store_revenue", "marketplace_only": "marketplace_revenue"}.get(scope, "revenue")
    return df.withColumn("revenue", F.col(source))


def tail_days(df: DataFrame, end, days: int) -> DataFrame:
    """The last ``days`` days before ``end``, inclusive start, for hold-out validation."""
    return df.filter(F.col("date") >= F.date_sub(F.lit(end).cast("date"), days))


def overlapping_events(events: DataFrame, start, end) -> DataFrame:
    """Events whose test interval meets [start, end]."""
    return events.filter(
        (F.col("test_start_date") <= F.lit(end).cast("date")) & (F.col("test_end_date") >= F.lit(start).cast("date"))
    )


def filter_events(events: DataFrame, channel: str | None = None, after=None) -> DataFrame:
    out = events if channel is None else events.filter(F.col("channel") == channel)
    if after is not None:
        out = out.filter(F.col("test_end_date") >= F.lit(after).cast("date"))
    return out


def validate_events(events: DataFrame) -> DataFrame:
    """Rule failures as an array (empty = accepted), implied ROI filled where 0, inclusive duration."""
    rules = [
        (~F.col("test_type").isin(*TEST_TYPES), "test_type"),
        (~F.col("outcome").isin(*OUTCOMES), "outcome"),
        (F.col("test_end_date") < F.col("test_start_date"), "dates"),
        (F.col("lift_lower_90") > F.col("lift_upper_90"), "interval"),
        (~(F.col("spend_in_period") > 0), "spend"),
    ]
    reasons = F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))
    implied = F.when(
        (F.coalesce(F.col("implied_roi"), F.lit(0.0)) == 0.0) & (F.col("spend_in_period") > 0),
        F.round(F.col("lift_abs") / F.col("spend_in_period"), 4),
    ).otherwise(F.col("implied_roi"))
    return (
        events.withColumn("rejected_reason", reasons)
        .withColumn("implied_roi", implied)
        .withColumn("duration_days", F.datediff("test_end_date", "test_start_date") + 1)
    )


def accepted(events: DataFrame) -> DataFrame:
    return events.filter(F.size("rejected_reason") == 0)
