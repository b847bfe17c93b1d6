"""Staging views, record rules and period predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.operators import marts, staging
from liftfield.sources import landed, tables
from parity.common import check, daily, market_lines, own_folder, r, spend_events, store_orders, table, tests_table, view

FIRST = "1996-01-01"

# raw store rows: orders with gaps so that every default and filter applies
view("x_raw_store", """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey AS VARCHAR) AS order_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS geo,
       CASE WHEN o_orderkey % 97 = 0 THEN -1.0 ELSE o_totalprice END AS gross_revenue,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 0.5 END AS discounts,
       CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 0.25 END AS returns,
       CASE WHEN o_orderkey % 101 = 0 THEN -10000.0 WHEN o_orderkey % 103 = 0 THEN -9999.0 ELSE o_totalprice * 0.5 END AS net_revenue,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 6 END AS units,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE f.first_key IS NOT NULL END AS new_customer,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS product_category
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN x_first_order f ON f.first_key = o_orderkey
""")
view("x_stg_store", f"""
SELECT date, order_id, geo, gross_revenue, coalesce(discounts, 0.0) AS discounts, coalesce(returns, 0.0) AS returns, net_revenue,
       coalesce(units, 1) AS units, coalesce(new_customer, false) AS new_customer, coalesce(product_category, 'unknown') AS product_category
FROM x_raw_store WHERE date >= DATE '{FIRST}' AND net_revenue > -10000 AND gross_revenue >= 0
""")
view("x_raw_market", """
SELECT date, okey, line, CASE WHEN item % 10 = 0 THEN NULL ELSE CAST(item AS VARCHAR) END AS item, CAST(NULL AS VARCHAR) AS product_name,
       CASE WHEN okey % 89 = 0 THEN -5.0 ELSE gross END AS gross_revenue,
       CASE WHEN flag = 'R' THEN gross * 0.5 END AS returns, gross * 0.5 AS net_revenue,
       CASE WHEN line % 3 = 0 THEN NULL ELSE units END AS units,
       CASE okey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'CA' ELSE 'US' END AS marketplace FROM x_market
""")
view("x_stg_market", f"""
SELECT date, coalesce(item, 'ALL') AS item, coalesce(product_name, 'unknown') AS product_name, gross_revenue,
       coalesce(returns, 0.0) AS returns, net_revenue, coalesce(units, 0) AS units, coalesce(marketplace, 'US') AS marketplace
FROM x_raw_market WHERE date >= DATE '{FIRST}' AND gross_revenue >= 0 AND marketplace = 'US'
""")


def raw_store(spark, sf):
    s = store_orders(spark, sf)
    first = s.groupBy("custkey").agg(F.min("okey").alias("first_key")).select("first_key")
    s = s.join(first, F.col("okey") == F.col("first_key"), "left")
    k, rev = F.col("okey"), F.col("revenue")
    return s.select(
        "date", "order_id", F.when(k % 13 != 0, F.col("geo")).alias("geo"),
        F.when(k % 97 == 0, -1.0).otherwise(rev).alias("gross_revenue"),
        F.when(k % 3 != 0, rev * 0.5).alias("discounts"), F.when(k % 5 == 0, rev * 0.25).alias("returns"),
        F.when(k % 101 == 0, -10000.0).when(k % 103 == 0, -9999.0).otherwise(rev * 0.5).alias("net_revenue"),
        F.when(k % 4 != 0, k % 6).alias("units"), F.when(k % 7 != 0, F.col("first_key").isNotNull()).alias("new_customer"),
        F.when(k % 2 == 0, F.col("priority")).alias("product_category"))


def stg_store(spark, sf):
    return staging.stage_orders(raw_store(spark, sf), FIRST)


def raw_market(spark, sf):
    m = market_lines(spark, sf)
    k, g = F.col("okey"), F.col("gross")
    return m.select(
        "date", F.when(F.col("item") % 10 != 0, F.col("item").cast("string")).alias("item"),
        F.lit(None).cast("string").alias("product_name"), F.when(k % 89 == 0, -5.0).otherwise(g).alias("gross_revenue"),
        F.when(F.col("flag") == "R", g * 0.5).alias("returns"), (g * 0.5).alias("net_revenue"),
        F.when(F.col("line") % 3 != 0, F.col("units")).alias("units"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "CA").otherwise("US").alias("marketplace"))


def stg_market(spark, sf):
    return staging.stage_marketplace(raw_market(spark, sf), FIRST)


@check("p01_stage_orders", "SELECT * FROM x_stg_store")
def p01(spark, sf):
    return stg_store(spark, sf)


@check("p02_stage_marketplace", "SELECT * FROM x_stg_market")
def p02(spark, sf):
    return stg_market(spark, sf)


# raw spend of three platforms out of the five event types
view("x_raw_social", """
SELECT date, geo, CASE WHEN channel = 'click' THEN 'performance' WHEN channel = 'view' THEN 'awareness' ELSE 'other' END AS channel,
       spend, k AS impressions, user_id AS reach, spend / 2 AS frequency, spend / 4 AS cpm
FROM x_events WHERE channel IN ('click', 'view', 'error')
""")
view("x_raw_search", """
SELECT date, geo, CASE WHEN k % 2 = 0 THEN 'google_brand' ELSE 'google_nonbrand' END AS channel, spend, k AS impressions,
       user_id AS clicks, spend / 2 AS conversions, spend / 4 AS cpc FROM x_events WHERE channel = 'purchase'
""")
view("x_raw_video", """
SELECT date, CASE WHEN k % 6 = 0 THEN NULL ELSE geo END AS geo, spend, k AS impressions, k AS video_views, user_id AS clicks, spend / 2 AS cpv
FROM x_events WHERE channel = 'signup'
""")


def raw_social(spark, sf):
    e = spend_events(spark, sf).filter(F.col("channel").isin("click", "view", "error"))
    ch = F.when(F.col("channel") == "click", "performance").when(F.col("channel") == "view", "awareness").otherwise("other")
    return e.select("date", "geo", ch.alias("channel"), F.col("spend").cast("string").alias("spend"), F.col("k").alias("impressions"),
                    F.col("user_id").alias("reach"), (F.col("spend") / 2).alias("frequency"), (F.col("spend") / 4).alias("cpm"))


def raw_search(spark, sf):
    e = spend_events(spark, sf).filter("channel = 'purchase'")
    ch = F.when(F.col("k") % 2 == 0, "google_brand").otherwise("google_nonbrand")
    return e.select("date", "geo", ch.alias("channel"), "spend", F.col("k").alias("impressions"), F.col("user_id").alias("clicks"),
                    (F.col("spend") / 2).alias("conversions"), (F.col("spend") / 4).alias("cpc"))


def raw_video(spark, sf):
    e = spend_events(spark, sf).filter("channel = 'signup'")
    return e.select("date", F.when(F.col("k") % 6 != 0, F.col("geo")).alias("geo"), "spend", F.col("k").alias("impressions"),
                    F.col("k").alias("video_views"), F.col("user_id").alias("clicks"), (F.col("spend") / 2).alias("cpv"))


SPEND_FIRST = "2001-07-05"


def stg_social(spark, sf):
    return staging.stage_spend(raw_social(spark, sf), staging.SOCIAL_COLUMNS, first_day=SPEND_FIRST)


def stg_search(spark, sf):
    return staging.stage_spend(raw_search(spark, sf), staging.SEARCH_COLUMNS, first_day=SPEND_FIRST)


def stg_video(spark, sf):
    return staging.stage_spend(raw_video(spark, sf), staging.VIDEO_COLUMNS, "tiktok", SPEND_FIRST)


for _n, _x in (("p03_stage_search", "x_raw_search"), ("p04_stage_social", "x_raw_social")):
    check(_n, f"SELECT * FROM {_x} WHERE date >= DATE '{SPEND_FIRST}'")(
        {"p03_stage_search": stg_search, "p04_stage_social": stg_social}[_n])
check("p05_stage_video", f"SELECT *, 'tiktok' AS channel FROM x_raw_video WHERE date >= DATE '{SPEND_FIRST}'")(stg_video)

ROUTES = {"performance": "meta_perf", "awareness": "meta_aware"}


@check("p06_channel_routing", f"""
SELECT date, geo, CASE channel WHEN 'performance' THEN 'meta_perf' ELSE 'meta_aware' END AS channel, spend
FROM x_raw_social WHERE date >= DATE '{SPEND_FIRST}' AND channel <> 'other'
""")
def p06(spark, sf):
    return staging.route_channels(stg_social(spark, sf), ROUTES).select("date", "geo", "channel", "spend")


@check("p07_paid_orders", "SELECT order_id, revenue FROM x_store WHERE status IN ('F', 'O')")
def p07(spark, sf):
    return marts.paid_only(store_orders(spark, sf), "status", ("F", "O")).select("order_id", "revenue")


@check("p08_periods", """
SELECT test_id, date, geo, round(revenue, 2) AS revenue, orders, CASE WHEN date < start_date THEN 'pre' ELSE 'post' END AS period
FROM x_daily JOIN x_tests ON date BETWEEN start_date - CAST(lookback_days AS INTEGER) AND end_date
""")
def p08(spark, sf):
    return staging.split_periods(daily(spark, sf), tests_table(spark)).withColumn("revenue", r(F.col("revenue"), 2))


@check("p09_scope_revenue", """
SELECT date, geo, round(s.revenue, 2) AS store_only, round(m.revenue, 4) AS marketplace_only FROM x_daily s JOIN x_market_daily m USING (date, geo)
""")
def p09(spark, sf):
    from parity.common import market_daily

    both = daily(spark, sf).select("date", "geo", F.col("revenue").alias("store_revenue")).join(
        market_daily(spark, sf).select("date", "geo", F.col("revenue").alias("marketplace_revenue")), ["date", "geo"]
    ).withColumn("revenue", F.lit(0.0))
    one = staging.scope_revenue(both, "store_only").withColumnRenamed("revenue", "store_only").withColumn("revenue", F.lit(0.0))
    out = staging.scope_revenue(one, "marketplace_only").withColumnRenamed("revenue", "marketplace_only")
    return out.select("date", "geo", r("store_only", 2).alias("store_only"), r("marketplace_only", 4).alias("marketplace_only"))


@check("p10_campaign_filter", "SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#2', 'Brand#17')")
def p10(spark, sf):
    return landed.only_ids(table(spark, sf, "part"), "p_brand", ["Brand#2", "Brand#17"]).select("p_partkey", "p_name")


@check("p11_date_window", "SELECT order_id, date FROM x_store WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'")
def p11(spark, sf):
    return landed.in_window(store_orders(spark, sf), "1999-01-01", "1999-03-31").select("order_id", "date")


@check("p12_holdout_tail", "SELECT order_id, date FROM x_store WHERE date >= DATE '2001-07-04'")
def p12(spark, sf):
    return staging.tail_days(store_orders(spark, sf), "2001-08-01", 28).select("order_id", "date")


# ---- calibration events out of orders -------------------------------------------------------

_TYPES = ("geo_holdout", "conversion_lift", "matched_market", "ghost_ad", "unknown_kind")
_OUTCOMES = ("shopify", "amazon", "combined", "retail")
view("x_cal", f"""
SELECT 'ch' || (o_custkey % 7) AS channel, {list(_TYPES)}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS test_type,
       {list(_OUTCOMES)}[CAST(o_custkey % 4 AS INTEGER) + 1] AS outcome, CAST(o_orderdate AS DATE) AS test_start_date,
       CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 - 3 AS INTEGER) AS DATE) AS test_end_date, o_totalprice AS lift_abs,
       o_totalprice - 100 AS lift_lower_90, o_totalprice + (o_orderkey % 5 - 1) * 100 - 100 AS lift_upper_90,
       CAST((o_custkey % 50) * 997 AS DOUBLE) AS spend_in_period, CASE WHEN o_orderkey % 2 = 0 THEN 0.0 ELSE 0.99 END AS implied_roi,
       o_orderkey AS ingested_seq
FROM orders
""")


def calibration_events(spark, sf):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("ch"), (c % 7).cast("string")).alias("channel"), pick(_TYPES, k % 5).alias("test_type"),
        pick(_OUTCOMES, c % 4).alias("outcome"), day.alias("test_start_date"),
        F.date_add(day, (k % 30 - 3).cast("int")).alias("test_end_date"), p.alias("lift_abs"), (p - 100).alias("lift_lower_90"),
        (p + (k % 5 - 1) * 100 - 100).alias("lift_upper_90"), ((c % 50) * 997).cast("double").alias("spend_in_period"),
        F.when(k % 2 == 0, 0.0).otherwise(0.99).alias("implied_roi"), k.alias("ingested_seq"))


view("x_cal_checked", """
SELECT *, concat_ws(',', CASE WHEN test_type = 'unknown_kind' THEN 'test_type' END, CASE WHEN outcome = 'retail' THEN 'outcome' END,
         CASE WHEN test_end_date < test_start_date THEN 'dates' END, CASE WHEN lift_lower_90 > lift_upper_90 THEN 'interval' END,
         CASE WHEN NOT spend_in_period > 0 THEN 'spend' END) AS reasons,
       CASE WHEN implied_roi = 0 AND spend_in_period > 0 THEN round(lift_abs / spend_in_period, 4) ELSE implied_roi END AS roi
FROM x_cal
""")
view("x_cal_ok", "SELECT * FROM x_cal_checked WHERE reasons = ''")


def good_events(spark, sf):
    return staging.accepted(staging.validate_events(calibration_events(spark, sf)))


@check("p13_overlapping_events", """
SELECT ingested_seq, channel, test_start_date, test_end_date FROM x_cal WHERE test_start_date <= DATE '1999-06-30' AND test_end_date >= DATE '1999-06-01'
""")
def p13(spark, sf):
    return staging.overlapping_events(calibration_events(spark, sf), "1999-06-01", "1999-06-30").select(
        "ingested_seq", "channel", "test_start_date", "test_end_date")


@check("p14_event_filter", "SELECT ingested_seq, channel FROM x_cal WHERE channel = 'ch3' AND test_end_date >= DATE '2000-01-01'")
def p14(spark, sf):
    return staging.filter_events(calibration_events(spark, sf), "ch3", "2000-01-01").select("ingested_seq", "channel")


@check("p15_event_rules", """
SELECT ingested_seq, reasons, round(roi, 4) AS implied_roi, CAST(test_end_date - test_start_date + 1 AS INTEGER) AS duration_days FROM x_cal_checked
""")
def p15(spark, sf):
    v = staging.validate_events(calibration_events(spark, sf))
    return v.select("ingested_seq", F.array_join("rejected_reason", ",").alias("reasons"), r(F.col("implied_roi"), 4).alias("implied_roi"), "duration_days")


@check("p16_table_contract", """
SELECT n_rows, unnest(['date', 'order_id', 'gross_revenue', 'net_revenue']) AS column_name, unnest([0, 0, 0, n_bad]) AS null_count
FROM (SELECT count(*) AS n_rows, CAST(count(*) FILTER (o_orderkey % 17 = 0) AS BIGINT) AS n_bad FROM orders)
""".replace("unnest([0, 0, 0, n_bad])", "unnest([CAST(0 AS BIGINT), 0, 0, n_bad])"))
def p16(spark, sf):
    raw = raw_store(spark, sf).withColumn("net_revenue", F.when(F.col("order_id").cast("bigint") % 17 != 0, F.col("net_revenue")))
    return tables.contract_breaches(raw, "store_revenue")


@check("s26_event_store_counts", """
SELECT channel, count(*) AS n_events, max(test_end_date) AS last_end FROM x_cal_ok GROUP BY channel
""")
def s26(spark, sf):
    """Filled, cleared, refilled with one half and appended with the other: each event is there once."""
    path, events = own_folder(spark), good_events(spark, sf)
    tables.add_events(events, path)
    tables.clear_events(spark, path)
    half = F.xxhash64("channel", "test_start_date", "test_end_date") % 2 == 0
    tables.replace_events(events.filter(half), path)
    tables.add_events(events.filter(~half), path)
    return tables.read_table(spark, path, "calibration_events").groupBy("channel").agg(F.count("*").alias("n_events"), F.max("test_end_date").alias("last_end"))
