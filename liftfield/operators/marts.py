"""Daily marts: store, marketplace and spend roll-ups and the model mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.sources.landed import in_window

PAID_STATUSES = ("paid", "partially_refunded")

# Spend columns of the model mart, in order.
MART_CHANNELS = (
    "meta_perf", "meta_aware", "google_brand", "google_nonbrand", "tiktok", "amz_sponsored", "email_sms",
)


def paid_only(orders: DataFrame, column: str = "financial_status", statuses=PAID_STATUSES) -> DataFrame:
    return orders.filter(F.col(column).isin(*statuses))


def geo_daily_revenue(orders: DataFrame) -> DataFrame:
    """Revenue and distinct orders per day and market."""
    return orders.groupBy("date", "geo").agg(
        F.sum("revenue").alias("revenue"), F.count_distinct("order_id").alias("orders")
    )


def orders_mart(staged: DataFrame) -> DataFrame:
    """Order sums, counts of new and returning customers and the new-customer rate; no market = UNMAPPED."""
    new = F.count_if("new_customer")
    return staged.groupBy("date", F.coalesce("geo", F.lit("UNMAPPED")).alias("geo")).agg(
        F.sum("gross_revenue").alias("gross_revenue"),
        F.sum("discounts").alias("total_discounts"),
        F.sum("returns").alias("total_returns"),
        F.sum("net_revenue").alias("net_revenue"),
        F.sum("units").alias("total_units"),
        F.count("*").alias("order_count"),
        new.alias("new_customer_orders"),
        F.count_if(~F.col("new_customer")).alias("returning_customer_orders"),
        F.try_divide(new, F.count("*")).alias("new_customer_rate"),
    )


def marketplace_mart(staged: DataFrame) -> DataFrame:
    """National marketplace totals per day under one pseudo market."""
    return staged.groupBy("date").agg(
        F.sum("gross_revenue").alias("gross_revenue"),
        F.sum("returns").alias("total_returns"),
        F.sum("net_revenue").alias("net_revenue"),
        F.sum("units").alias("total_units"),
        F.count_distinct("item").alias("distinct_items"),
    ).select("date", F.lit("NATIONAL").alias("geo"), "gross_revenue", "total_returns", "net_revenue", "total_units", "distinct_items")


def spend_mart(social: DataFrame, search: DataFrame, video: DataFrame) -> DataFrame:
    """Spend per day, market and channel over all platforms; video rows without a market are left out.

    Each platform is summed below the union, so the shuffle carries aggregates only.
    """
    parts = [social, search, video.filter("geo IS NOT NULL")]
    cols = ["date", "geo", "channel", "spend"]
    out = parts[0].select(cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(cols))
    return out.groupBy("date", "geo", "channel").agg(F.sum("spend").alias("spend"))


def pivot_channels(spend: DataFrame, channels=MART_CHANNELS) -> DataFrame:
    """One spend column per channel as conditional sums; other channels are dropped."""
    return spend.groupBy("date", "geo").agg(
        *[F.sum(F.when(F.col("channel") == c, F.col("spend")).otherwise(0.0)).alias(f"{c}_spend") for c in channels]
    )


def spend_window(platforms: list[DataFrame], start, end) -> DataFrame:
    """Spend per day, market and channel of several raw tables in one window, nulls as 0."""
    out = None
    for p in platforms:
        part = in_window(p, start, end).groupBy("date", "geo", "channel").agg(
            F.coalesce(F.sum(F.col("spend").cast("double")), F.lit(0.0)).alias("spend")
        )
        out = part if out is None else out.unionByName(part)
    return out


def revenue_window(store: DataFrame, marketplace: DataFrame, start, end) -> DataFrame:
    """Market-level store revenue and national marketplace revenue, tagged by source."""
    total = F.coalesce(F.sum(F.col("net_revenue").cast("double")), F.lit(0.0)).alias("net_revenue")
    a = in_window(store, start, end).groupBy("date", "geo").agg(total)
    b = in_window(marketplace, start, end).groupBy("date").agg(total)
    return a.select("date", "geo", F.lit("shopify").alias("source"), "net_revenue").unionByName(
        b.select("date", F.lit("NATIONAL").alias("geo"), F.lit("amazon").alias("source"), "net_revenue")
    )


def merge_platform_revenue(frames: dict[str, DataFrame]) -> DataFrame:
    """Full outer merge of (date, geo, revenue, orders) per platform, missing as 0, plus totals.

    Written as one tagged union and one conditional aggregate: a single shuffle for any number of platforms.
    """
    tagged = None
    for name, df in frames.items():
        part = df.select("date", "geo", F.lit(name).alias("platform"), "revenue", F.col("orders").cast("double"))
        tagged = part if tagged is None else tagged.unionByName(part)
    aggs = []
    for name in frames:
        hit = F.col("platform") == name
        aggs += [
            F.sum(F.when(hit, F.col("revenue")).otherwise(0.0)).alias(f"{name}_revenue"),
            F.sum(F.when(hit, F.col("orders")).otherwise(0.0)).alias(f"{name}_orders"),
        ]
    return tagged.groupBy("date", "geo").agg(
        *aggs,
        F.sum("revenue").alias("revenue"),
        F.bround(F.coalesce(F.sum("orders"), F.lit(0.0)), 0).cast("bigint").alias("orders"),
    )


def model_mart(pivoted: DataFrame, orders: DataFrame, keep_unspent: bool = False) -> DataFrame:
    """Pivoted spend with store revenue; ``keep_unspent`` also keeps market-days with revenue but no spend."""
    revenue = orders.filter("geo <> 'UNMAPPED'").select("date", "geo", F.col("net_revenue").alias("store_net_revenue"))
    joined = pivoted.join(revenue, ["date", "geo"], "full" if keep_unspent else "left")
    return joined.fillna(0.0)


def model_inputs(platforms, store, marketplace, events, start, end) -> dict[str, DataFrame]:
    """Spend, revenue and calibration tables of one window."""
    from liftfield.operators.staging import overlapping_events

    return {
        "spend": spend_window(platforms, start, end),
        "revenue": revenue_window(store, marketplace, start, end),
        "calibration": overlapping_events(events, start, end),
    }
