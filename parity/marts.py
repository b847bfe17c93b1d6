"""Daily marts and platform merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.operators import marts, panel, staging
from parity.common import check, daily, market_daily, rounded, spend_daily, view
from parity.staging import (
    ROUTES, calibration_events, raw_market, raw_search, raw_social, raw_store, raw_video, stg_market, stg_search, stg_social,
    stg_store, stg_video, SPEND_FIRST,
)


@check("a01_daily_geo_revenue", "SELECT date, geo, round(revenue, 2) AS revenue, orders FROM x_daily")
def a01(spark, sf):
    return rounded(daily(spark, sf), 2)


view("x_orders_mart", """
SELECT date, coalesce(geo, 'UNMAPPED') AS geo, sum(gross_revenue) AS gross_revenue, sum(discounts) AS total_discounts,
       sum(returns) AS total_returns, sum(net_revenue) AS net_revenue, CAST(sum(units) AS BIGINT) AS total_units, count(*) AS order_count,
       count(*) FILTER (new_customer) AS new_customer_orders, count(*) FILTER (NOT new_customer) AS returning_customer_orders,
       count(*) FILTER (new_customer) / count(*) AS new_customer_rate FROM x_stg_store GROUP BY 1, 2
""")


@check("a02_orders_mart", """
SELECT date, geo, round(gross_revenue, 2) AS gross_revenue, round(total_discounts, 3) AS total_discounts, round(total_returns, 4) AS total_returns,
       round(net_revenue, 3) AS net_revenue, total_units, order_count, new_customer_orders, returning_customer_orders,
       round(new_customer_rate, 6) AS new_customer_rate FROM x_orders_mart
""")
def a02(spark, sf):
    return rounded(marts.orders_mart(stg_store(spark, sf)), 3, gross_revenue=2, total_returns=4, new_customer_rate=6)


view("x_market_mart", """
SELECT date, 'NATIONAL' AS geo, sum(gross_revenue) AS gross_revenue, sum(returns) AS total_returns, sum(net_revenue) AS net_revenue,
       CAST(sum(units) AS BIGINT) AS total_units, count(DISTINCT item) AS distinct_items FROM x_stg_market GROUP BY date
""")


@check("a03_marketplace_mart", """
SELECT date, geo, round(gross_revenue, 2) AS gross_revenue, round(total_returns, 3) AS total_returns, round(net_revenue, 3) AS net_revenue,
       total_units, distinct_items FROM x_market_mart
""")
def a03(spark, sf):
    return rounded(marts.marketplace_mart(stg_market(spark, sf)), 3, gross_revenue=2)


view("x_spend_mart", f"""
SELECT date, geo, channel, sum(spend) AS spend FROM (
  SELECT date, geo, CASE channel WHEN 'performance' THEN 'meta_perf' ELSE 'meta_aware' END AS channel, spend FROM x_raw_social WHERE channel <> 'other'
  UNION ALL SELECT date, geo, channel, spend FROM x_raw_search
  UNION ALL SELECT date, geo, 'tiktok', spend FROM x_raw_video WHERE geo IS NOT NULL) WHERE date >= DATE '{SPEND_FIRST}' GROUP BY 1, 2, 3
""")


def spend_mart(spark, sf):
    return marts.spend_mart(staging.route_channels(stg_social(spark, sf), ROUTES), stg_search(spark, sf), stg_video(spark, sf))


@check("a04_spend_mart", "SELECT date, geo, channel, round(spend, 2) AS spend FROM x_spend_mart")
def a04(spark, sf):
    return rounded(spend_mart(spark, sf), 2)


_PIVOT = ", ".join(f"sum(CASE WHEN channel = '{c}' THEN spend ELSE 0.0 END) AS {c}_spend" for c in marts.MART_CHANNELS)
_PIVOT_COLS = ", ".join(f"round({c}_spend, 2) AS {c}_spend" for c in marts.MART_CHANNELS)
view("x_pivot", f"SELECT date, geo, {_PIVOT} FROM x_spend_mart GROUP BY 1, 2")


@check("a05_channel_pivot", f"SELECT date, geo, {_PIVOT_COLS} FROM x_pivot")
def a05(spark, sf):
    return rounded(marts.pivot_channels(spend_mart(spark, sf)), 2)


A, B = "2001-07-08", "2001-07-21"
view("x_spend_window", "\nUNION ALL\n".join(
    f"SELECT date, geo, {ch} AS channel, sum(spend) AS spend FROM {src} WHERE date BETWEEN DATE '{A}' AND DATE '{B}' GROUP BY 1, 2, 3"
    for ch, src in (("channel", "x_raw_social"), ("channel", "x_raw_search"), ("'tiktok'", "x_raw_video"))))


def raw_platforms(spark, sf):
    return [raw_social(spark, sf), raw_search(spark, sf), raw_video(spark, sf).withColumn("channel", F.lit("tiktok"))]


@check("a06_spend_window", "SELECT date, geo, channel, round(spend, 2) AS spend FROM x_spend_window")
def a06(spark, sf):
    return rounded(marts.spend_window(raw_platforms(spark, sf), A, B), 2)


view("x_revenue_window", f"""
SELECT date, geo, 'shopify' AS source, sum(net_revenue) AS net_revenue FROM x_raw_store WHERE date BETWEEN DATE '{A}' AND DATE '{B}' GROUP BY 1, 2
UNION ALL SELECT date, 'NATIONAL', 'amazon', sum(net_revenue) FROM x_raw_market WHERE date BETWEEN DATE '{A}' AND DATE '{B}' GROUP BY 1
""")


@check("a07_revenue_window", "SELECT date, geo, source, round(net_revenue, 3) AS net_revenue FROM x_revenue_window")
def a07(spark, sf):
    return rounded(marts.revenue_window(raw_store(spark, sf), raw_market(spark, sf), A, B), 3)


@check("a08_model_inputs", f"""
SELECT 'spend' AS part, count(*) AS n_rows, round(sum(spend), 3) AS total FROM x_spend_window
UNION ALL SELECT 'revenue', count(*), round(sum(net_revenue), 3) FROM x_revenue_window
UNION ALL SELECT 'calibration', count(*), round(sum(lift_abs), 3) FROM x_cal WHERE test_start_date <= DATE '{B}' AND test_end_date >= DATE '{A}'
""")
def a08(spark, sf):
    parts = marts.model_inputs(raw_platforms(spark, sf), raw_store(spark, sf), raw_market(spark, sf), calibration_events(spark, sf), A, B)
    out = None
    for name, amount in (("spend", "spend"), ("revenue", "net_revenue"), ("calibration", "lift_abs")):
        row = parts[name].agg(F.lit(name).alias("part"), F.count("*").alias("n_rows"), F.round(F.sum(amount), 3).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


view("x_merged", """
SELECT date, geo, coalesce(s.revenue, 0) AS store_revenue, coalesce(s.orders, 0) AS store_orders, coalesce(m.revenue, 0) AS marketplace_revenue,
       coalesce(m.orders, 0) AS marketplace_orders, coalesce(s.revenue, 0) + coalesce(m.revenue, 0) AS revenue,
       CAST(coalesce(s.orders, 0) + coalesce(m.orders, 0) AS BIGINT) AS orders
FROM x_daily s FULL JOIN x_market_daily m USING (date, geo)
""")


def merged(spark, sf):
    return marts.merge_platform_revenue({"store": daily(spark, sf), "marketplace": market_daily(spark, sf)})


@check("j05_platform_merge", """
SELECT date, geo, round(store_revenue, 2) AS store_revenue, CAST(store_orders AS DOUBLE) AS store_orders, round(marketplace_revenue, 4) AS marketplace_revenue,
       CAST(marketplace_orders AS DOUBLE) AS marketplace_orders, round(revenue, 4) AS revenue, orders FROM x_merged
""")
def j05(spark, sf):
    return rounded(merged(spark, sf), 4, store_revenue=2)


def _mart_sql(kind: str) -> str:
    cols = ", ".join(f"round(coalesce({c}_spend, 0), 2) AS {c}_spend" for c in marts.MART_CHANNELS)
    return f"""SELECT date, geo, {cols}, round(coalesce(r.net_revenue, 0), 3) AS store_net_revenue
    FROM x_pivot s {kind} JOIN (SELECT date, geo, net_revenue FROM x_orders_mart WHERE geo <> 'UNMAPPED') r USING (date, geo)"""


@check("j06_model_mart", _mart_sql("LEFT"))
def j06(spark, sf):
    m = marts.model_mart(marts.pivot_channels(spend_mart(spark, sf)), marts.orders_mart(stg_store(spark, sf)))
    return rounded(m, 2, store_net_revenue=3)


@check("j06_model_mart_full", _mart_sql("FULL"))
def j06b(spark, sf):
    m = marts.model_mart(marts.pivot_channels(spend_mart(spark, sf)), marts.orders_mart(stg_store(spark, sf)), keep_unspent=True)
    return rounded(m, 2, store_net_revenue=3)


@check("u01_union_sources", """
SELECT source, count(*) AS n, count(orders) AS n_orders, round(sum(revenue), 2) AS revenue FROM (
  SELECT 'store' AS source, revenue, orders FROM x_daily UNION ALL SELECT 'marketplace', revenue, orders FROM x_market_daily
  UNION ALL SELECT 'spend', spend, NULL FROM x_spend) GROUP BY 1
""")
def u01(spark, sf):
    u = panel.union_tagged({
        "store": daily(spark, sf), "marketplace": market_daily(spark, sf),
        "spend": spend_daily(spark, sf).select("date", "geo", F.col("spend").alias("revenue"))})
    return rounded(u.groupBy("source").agg(F.count("*").alias("n"), F.count("orders").alias("n_orders"), F.sum("revenue").alias("revenue")), 2)
