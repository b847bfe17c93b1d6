"""Raw layouts rebuilt from the driver's tables, run through the normalisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.functions import scalars as S
from liftfield.operators import lookups
from liftfield.sources import ads, attribution, commerce, landed, messaging, tables
from parity.common import (
    check, geos, own_folder, r, rounded, spend_daily, spend_events, table, view,
)

# ---- S01, S02, S07: commerce ----------------------------------------------------------------

view("x_rawzip", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, CAST(o_orderdate AS DATE) AS day,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE lpad(CAST(o_custkey * 37 % 100000 AS VARCHAR), 5, '0') || '-1234' END AS zip
FROM orders
""")


def raw_orders(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    address = F.when(key % 11 != 0, F.struct(
        F.concat(F.lpad((F.col("o_custkey") * 37 % 100000).cast("string"), 5, "0"), F.lit("-1234")).alias("zip"),
        F.lit("CA").alias("province_code"), F.lit("Town").alias("city")))
    body = F.to_json(F.struct(
        key.alias("id"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:30:00-05:00")).alias("created_at"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total_price"),
        (F.col("o_totalprice") * 0.5).cast("decimal(18,3)").cast("string").alias("subtotal_price"),
        F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "P", "partially_refunded")
        .otherwise("pending").alias("financial_status"),
        F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda i: F.struct(i.cast("bigint").alias("id"))).alias("line_items"),
        address.alias("shipping_address"),
    ), {"ignoreNullFields": "true"})
    return landed.parse_json(o.select(body.alias("value")), "value", commerce.ORDER_JSON)


@check("s01_orders", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, day AS date, o_totalprice AS total_price,
       coalesce(substr(zip, 1, 5), '') AS shipping_zip, CASE WHEN zip IS NULL THEN '' ELSE 'CA' END AS shipping_state,
       CASE WHEN zip IS NULL THEN '' ELSE 'Town' END AS shipping_city, o_orderkey % 4 + 1 AS line_items_count,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'partially_refunded' ELSE 'pending' END AS financial_status
FROM x_rawzip
""")
def s01(spark, sf):
    return commerce.normalise_orders(raw_orders(spark, sf)).drop("created_at", "subtotal_price")


def raw_marketplace(spark, sf):
    o = table(spark, sf, "orders")
    body = F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("purchase_date"),
        F.when(F.col("o_orderstatus") == "F", "Shipped").when(F.col("o_orderstatus") == "O", "Delivered")
        .otherwise("Pending").alias("order_status"),
        F.struct(F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Amount"), F.lit("USD").alias("CurrencyCode")).alias("order_total"),
        F.struct(F.when(F.col("o_orderkey") % 5 == 0, "12").otherwise("90210-77").alias("PostalCode")).alias("shipping_address"),
        (F.col("o_orderkey") % 3).alias("items")))
    return landed.parse_json(o.select(body.alias("value")), "value", commerce.MARKETPLACE_JSON)


@check("s02_marketplace_orders", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS total,
       CASE WHEN o_orderkey % 5 = 0 THEN '12' ELSE '90210' END AS shipping_zip, '' AS shipping_state,
       o_orderkey % 3 AS items, CASE o_orderstatus WHEN 'F' THEN 'Shipped' ELSE 'Delivered' END AS order_status
FROM orders WHERE o_orderstatus IN ('F', 'O')
""")
def s02(spark, sf):
    return commerce.normalise_marketplace(raw_marketplace(spark, sf))


@check("s02_zip_coverage", """
SELECT count(*) AS n_orders, count(*) FILTER (o_orderkey % 5 <> 0) AS n_with_zip,
       round(100.0 * count(*) FILTER (o_orderkey % 5 <> 0) / count(*), 6) AS zip_coverage_pct
FROM orders WHERE o_orderstatus IN ('F', 'O')
""")
def s02b(spark, sf):
    return rounded(commerce.zip_coverage(commerce.normalise_marketplace(raw_marketplace(spark, sf))))


@check("s03_social_spend", """
SELECT CAST(ts AS DATE) AS date, g.geo, g.name, value AS spend, CAST(json_extract(props, '$.k') AS BIGINT) AS impressions,
       user_id AS clicks
FROM events JOIN x_geos g ON g.num = user_id % 25 WHERE user_id % 25 < 20
""")
def s03(spark, sf):
    good, _ = ads.social_spend_by_market(*_social(spark, sf))
    # the looked-up name, not the raw spelling, so that the oracle can state it
    dim = geos(spark, sf).select("geo", F.col("name").alias("market"))
    return good.drop("name").join(dim, "geo").withColumnRenamed("market", "name")


@check("s03_unmapped_names", """
SELECT 'Nowhere ' || (user_id % 25) AS name, count(*) AS n_rows FROM events WHERE user_id % 25 >= 20 GROUP BY 1
""")
def s03b(spark, sf):
    return ads.social_spend_by_market(*_social(spark, sf))[1]


def _social(spark, sf):
    e = table(spark, sf, "events")
    g = F.col("user_id") % 25
    base = F.concat(F.lit("NATION_"), g.cast("string"))
    spelled = (
        F.when(g >= 20, F.concat(F.lit("Nowhere "), g.cast("string")))
        .when(F.col("event_id") % 4 == 0, base)
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), F.lower(base), F.lit("  ")))
        .when(F.col("event_id") % 4 == 2, F.concat(base, F.lit(", ST")))
        .otherwise(F.concat(F.lower(base), F.lit(" , XX")))
    )
    raw = e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date_start"), spelled.alias("market_name"),
        F.col("value").cast("string").alias("spend"), F.get_json_object("props", "$.k").alias("impressions"),
        F.col("user_id").cast("string").alias("clicks"))
    return raw, geos(spark, sf).select("name", "geo")


def _platform_ids(spark, sf, below: int = 18):
    return geos(spark, sf).filter(F.col("num") < below).select(
        (F.col("num") + 200500).cast("string").alias("platform_id"), "geo")


@check("s04_video_spend", """
SELECT date, geo, round(spend, 6) AS spend, k AS impressions, k % 3 AS views, 0.25 AS view_rate, user_id AS clicks,
       round(CASE WHEN k % 3 > 0 THEN spend / (k % 3) ELSE 0 END, 6) AS cost_per_view
FROM (SELECT CAST(ts AS DATE) AS date, CAST(user_id % 25 AS VARCHAR) AS geo, value AS spend, user_id,
             CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE CAST(geo AS INTEGER) < 18
""")
def s04(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("geoTargetConstants/"), (F.col("user_id") % 25 + 200500).cast("string")).alias("geo_resource"),
        F.round(F.col("value") * 1e6).cast("bigint").cast("string").alias("cost_micros"),
        k.cast("string").alias("impressions"), (k % 3).cast("string").alias("views"),
        F.lit("0.25").alias("view_rate"), F.col("user_id").cast("string").alias("clicks"))
    return rounded(ads.video_spend_by_market(raw, _platform_ids(spark, sf)))


def _region_video(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        (F.col("user_id") % 40).cast("string").alias("campaign_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("State "), (F.col("user_id") % 30).cast("string")).alias("region"),
        F.when(F.col("event_id") % 9 != 0, F.col("value").cast("string")).alias("spend"),
        k.cast("string").alias("impressions"), F.when(k % 5 != 0, k.cast("string")).alias("video_views"),
        (k % 7).cast("string").alias("video_completions"))


view("x_region_video", """
SELECT user_id % 40 AS campaign, CAST(ts AS DATE) AS date, 'State ' || (user_id % 30) AS region,
       CASE WHEN event_id % 9 <> 0 THEN value ELSE 0 END AS spend, k AS impressions,
       CASE WHEN k % 5 <> 0 THEN k ELSE 0 END AS video_views, k % 7 AS video_completions
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
""")


@check("s05_region_video_spend", """
SELECT date, region, spend, impressions, video_views, video_completions FROM x_region_video
""")
def s05(spark, sf):
    return ads.region_video_spend(_region_video(spark, sf))


@check("s06_objective_spend", """
SELECT date, region, round(sum(spend), 2) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions,
       CAST(sum(video_views) AS BIGINT) AS video_views, CAST(sum(video_completions) AS BIGINT) AS video_completions
FROM x_region_video WHERE campaign IN (SELECT user_id % 40 FROM events WHERE user_id % 40 % 3 = 0) GROUP BY date, region
""")
def s06(spark, sf):
    raw = _region_video(spark, sf)
    objective = F.when(F.col("campaign_id").cast("int") % 3 == 0, "Gmv_Max").otherwise("REACH")
    campaigns = raw.select("campaign_id").distinct().withColumn("objective", objective)
    return rounded(ads.region_spend_for_objective(raw, campaigns, "gmv_max"), 2)


@check("s07_shop_sales", """
SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS gmv, o_orderkey % 5 AS orders, o_orderkey % 9 AS units_sold,
       round(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice * 0.15 WHEN 1 THEN 0 ELSE 12.5 END, 4) AS affiliate_commission,
       CAST(0 AS BIGINT) AS creator_count,
       round(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice * 0.15 WHEN 1 THEN 0 ELSE 12.5 END, 4) AS estimated_spend
FROM orders
""")
def s07(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    front = F.concat(
        F.lit('{"date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","gmv":"'),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit('","orders":"'), (key % 5).cast("string"),
        F.lit('","units_sold":"'), (key % 9).cast("string"), F.lit('"'))
    tail = F.when(key % 3 == 0, "}").when(key % 3 == 1, ',"affiliate_commission":null}').otherwise(
        ',"affiliate_commission":"12.5"}')
    raw = o.select(F.from_json(F.concat(front, tail), "map<string,string>").alias("fields"))
    return rounded(commerce.normalise_shop_sales(raw), 4)


# ---- S08–S12: other ad sources --------------------------------------------------------------


def _pins(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("US-"), (F.col("user_id") % 30).cast("string")).alias("region"),
        F.round(F.col("value") * 1e6).cast("bigint").cast("string").alias("spend_in_micro_dollar"),
        k.alias("impressions"), F.col("user_id").cast("string").alias("clicks"),
        F.lit("1").alias("saves"), F.lit(None).cast("string").alias("pin_clicks"))


@check("s08_region_pin_spend", """
SELECT CAST(ts AS DATE) AS date, 'US-' || (user_id % 30) AS region, round(value, 6) AS spend,
       CAST(json_extract(props, '$.k') AS BIGINT) AS impressions, user_id AS clicks, CAST(1 AS BIGINT) AS saves,
       CAST(0 AS BIGINT) AS pin_clicks FROM events
""")
def s08(spark, sf):
    return rounded(ads.region_pin_spend(_pins(spark, sf)))


@check("s09_national_pin_spend", """
SELECT CAST(ts AS DATE) AS date, round(sum(value), 2) AS spend, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS impressions,
       CAST(sum(user_id) AS BIGINT) AS clicks FROM events GROUP BY 1
""")
def s09(spark, sf):
    return rounded(ads.national_daily(ads.region_pin_spend(_pins(spark, sf)), ("spend", "impressions", "clicks")), 2)


@check("s10_app_network_spend", """
SELECT CAST(ts AS DATE) AS date, round(sum(value), 2) AS spend, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS impressions,
       CAST(sum(user_id) AS BIGINT) AS clicks, CAST(sum(event_id % 2) AS BIGINT) AS installs
FROM events WHERE event_id % 10 <> 0 GROUP BY 1
""")
def s10(spark, sf):
    e = table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    n = F.col("event_id") % 10
    raw = e.select(
        F.when(n < 5, "").when(n == 5, None).otherwise(day).alias("day"),
        F.when(n == 0, "").when(n < 6, day).alias("date"),
        F.col("value").cast("string").alias("cost"), F.get_json_object("props", "$.k").alias("impressions"),
        F.col("user_id").cast("string").alias("clicks"), (F.col("event_id") % 2).cast("string").alias("conversions"))
    return rounded(ads.app_network_daily(raw), 2)


def _tv(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("user_id") % 25).alias("market_code"),
        F.lit("m").alias("market_name"), F.col("value").cast("string").alias("spend"),
        F.get_json_object("props", "$.k").alias("grps"), F.col("user_id").cast("string").alias("impressions"),
        F.lit("2").alias("airings"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("placement_type"))


view("x_tv", """
SELECT CAST(ts AS DATE) AS date, CAST(user_id % 25 AS VARCHAR) AS geo, 'm' AS name, value AS spend,
       CAST(json_extract(props, '$.k') AS DOUBLE) AS grps, user_id AS impressions, CAST(2 AS BIGINT) AS airings,
       CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS placement_type FROM events
""")


@check("s11_tv_airings", "SELECT * FROM x_tv")
def s11(spark, sf):
    return ads.tv_airings(_tv(spark, sf))


@check("s12_tv_national", """
SELECT date, round(sum(spend), 2) AS spend, round(sum(grps), 2) AS grps, CAST(sum(impressions) AS BIGINT) AS impressions,
       CAST(sum(airings) AS BIGINT) AS airings FROM x_tv GROUP BY date
""")
def s12(spark, sf):
    return rounded(ads.national_daily(ads.tv_airings(_tv(spark, sf)), ("spend", "grps", "impressions", "airings")), 2)


# ---- S13, S14: messaging --------------------------------------------------------------------


@check("s13_sms_daily", """
SELECT date, count(*) AS campaigns_sent, CAST(sum(sends) AS BIGINT) AS total_sends, CAST(sum(clicks) AS BIGINT) AS clicks,
       round(sum(revenue), 2) AS revenue, CAST(0 AS BIGINT) AS unsubscribes, round(sum(sends) * 0.01, 2) AS estimated_spend
FROM (SELECT CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS date, o_custkey AS sends,
             o_orderkey % 17 AS clicks, o_totalprice AS revenue FROM orders)
WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY date
""")
def s13(spark, sf):
    o = table(spark, sf, "orders")
    day = lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T08:00:00Z"))
    third = F.col("o_orderkey") % 3 == 0
    campaigns = o.select(
        F.col("o_orderkey").alias("campaign_id"), day(F.col("o_orderdate")).alias("created_at"),
        F.when(third, day(F.date_add(F.col("o_orderdate").cast("date"), 1))).otherwise("").alias("sent_at"))
    analytics = o.select(
        F.col("o_orderkey").alias("campaign_id"), F.col("o_custkey").cast("string").alias("sent"),
        (F.col("o_orderkey") % 17).cast("string").alias("clicked"),
        F.col("o_totalprice").cast("string").alias("revenue_attributed"), F.lit(None).cast("string").alias("unsubscribes"))
    return rounded(messaging.sms_daily(campaigns, analytics, "1998-01-01", "1999-12-31"), 2)


@check("s14_email_daily", """
SELECT date, count(*) AS campaigns_sent, CAST(coalesce(sum(delivered), 0) AS BIGINT) AS delivered,
       CAST(coalesce(sum(opened), 0) AS BIGINT) AS opened, CAST(coalesce(sum(clicked), 0) AS BIGINT) AS clicked,
       round(coalesce(sum(revenue), 0), 2) AS revenue, CAST(0 AS BIGINT) AS unsubscribed,
       round(coalesce(sum(delivered), 0) * 0.02, 2) AS estimated_spend
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders) c
LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS delivered, sum(l_linenumber) AS opened,
                  sum(l_partkey % 3) AS clicked, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1) m ON l_orderkey = o_orderkey
WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' GROUP BY date
""")
def s14(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    campaigns = o.select(
        F.col("o_orderkey").alias("campaign_id"), F.lit(None).cast("string").alias("send_time"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("scheduled_at"))
    messages = li.select(
        F.col("l_orderkey").alias("campaign_id"), F.col("l_quantity").cast("string").alias("delivered"),
        F.col("l_linenumber").cast("string").alias("opened_unique"), (F.col("l_partkey") % 3).cast("string").alias("clicked_unique"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("revenue"), F.lit(None).cast("string").alias("unsubscribed"))
    return rounded(messaging.email_daily(campaigns, messages, "1998-01-01", "1999-12-31"), 2)


# ---- S15–S17 --------------------------------------------------------------------------------


@check("s15_attribution", """
SELECT CAST(ts AS DATE) AS date, 'paid_' || event_type || '_x_y' AS channel, value AS attributed_revenue,
       CAST(json_extract(props, '$.k') AS DOUBLE) AS attributed_conversions, CAST(28 AS BIGINT) AS attribution_window FROM events
""")
def s15(spark, sf):
    return attribution.channel_attribution(table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("Paid - "), F.initcap("event_type"), F.lit(" X-Y")).alias("channel"),
        F.col("value").cast("string").alias("attributed_revenue"),
        F.get_json_object("props", "$.k").alias("attributed_conversions")))


view("x_first_order", "SELECT o_custkey, min(o_orderkey) AS first_key FROM orders GROUP BY 1")


@check("s16_new_returning", """
SELECT date, channel, round(n, 2) AS new_revenue, round(t, 2) AS returning_revenue, round(CASE WHEN n + t > 0 THEN n / (n + t) ELSE 0 END, 6) AS new_pct
FROM (SELECT CAST(o_orderdate AS DATE) AS date, lower(replace(o_orderpriority, '-', '_')) AS channel,
             sum(CASE WHEN f.first_key IS NOT NULL THEN o_totalprice ELSE 0 END) AS n,
             sum(CASE WHEN f.first_key IS NULL THEN o_totalprice ELSE 0 END) AS t
      FROM orders LEFT JOIN x_first_order f ON f.first_key = o_orderkey GROUP BY 1, o_orderpriority)
""".replace("lower(replace(o_orderpriority, '-', '_'))", "replace(lower(replace(o_orderpriority, '-', '_')), ' ', '_')"))
def s16(spark, sf):
    o = table(spark, sf, "orders")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key")).select("first_key")
    tagged = o.join(first, F.col("o_orderkey") == F.col("first_key"), "left")
    is_new = F.col("first_key").isNotNull()
    raw = tagged.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("channel")).agg(
        F.sum(F.when(is_new, F.col("o_totalprice")).otherwise(0.0)).alias("new_revenue"),
        F.sum(F.when(~is_new, F.col("o_totalprice")).otherwise(0.0)).alias("returning_revenue"))
    return rounded(attribution.new_returning_split(raw), 2, new_pct=6)


@check("s17_campaigns", """
SELECT CAST(p_partkey AS VARCHAR) AS campaign_id, p_name AS name, p_brand AS status, p_type AS objective,
       round(p_retailprice, 4) AS budget FROM part
""")
def s17(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("status"),
        F.col("p_type").alias("objective"), (F.col("p_retailprice") * 100).cast("decimal(18,2)").cast("string").alias("budget"))
    return rounded(ads.campaign_dimension(raw, 100), 4)


# ---- S18–S26: tables ------------------------------------------------------------------------


@check("s18_parquet_source", """
SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def s18(spark, sf):
    cols = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    folder = own_folder(spark)
    landed.write_cache(landed.read_parquet(spark, f"{sf}/orders.parquet", cols), folder, "orders")
    got = landed.read_cache(spark, folder, "orders", cols)
    none = landed.read_parquet(spark, f"{sf}/absent.parquet", cols)
    return rounded(got.unionByName(none).groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@check("s19_csv_source", """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 25 AS VARCHAR) AS geo, o_totalprice AS revenue FROM orders
""")
def s19(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), (F.col("o_custkey") % 25).cast("string").alias("geo"),
        F.col("o_totalprice").alias("revenue"))
    path = landed.daily_csv_path(own_folder(spark), "store")
    tables.write_report(o, path)
    schema = "date date, geo string, revenue double"
    return landed.read_csv(spark, path, schema).unionByName(landed.read_csv(spark, f"{path}.absent", schema))


@check("s20_load_stamp", """
SELECT date, count(*) AS n_rows, count(*) AS n_stamped, round(sum(spend), 2) AS spend FROM x_spend GROUP BY date
""")
def s20(spark, sf):
    path, rows = own_folder(spark), spend_daily(spark, sf)
    for part in ("channel = 'click'", "channel <> 'click'"):
        tables.append_rows(rows.filter(part), path, "daily_spend")
    return rounded(tables.read_table(spark, path, "daily_spend").groupBy("date").agg(
        F.count("*").alias("n_rows"), F.count("loaded_at").alias("n_stamped"), F.sum("spend").alias("spend")), 2)


@check("s21_load_summary", "SELECT count(*) AS rows_written, round(sum(spend), 2) AS total_spend FROM x_spend")
def s21(spark, sf):
    return rounded(tables.load_summary(spend_daily(spark, sf), "spend"), 2)


@check("s22_store_latest", """
SELECT test_id, status, n_rows FROM (
  SELECT 'test_' || (o_custkey % 50) AS test_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS n_rows
  FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1) WHERE status = 'F'
""")
def s22(spark, sf):
    o = table(spark, sf, "orders")
    body = F.to_json(F.struct(
        F.concat(F.lit("test_"), (F.col("o_custkey") % 50).cast("string")).alias("test_id"), F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))
    text = F.when(F.col("o_orderkey") % 50 == 0, F.lit('{"test_id": ')).otherwise(body)
    folder = own_folder(spark)
    o.select(text.alias("value")).write.text(folder)
    store = tables.list_store(spark, folder, "test_id string, k bigint, status string, day date")
    newest = tables.latest_saved(store, ["test_id"], ["day", "k"])
    n = store.groupBy("test_id").agg(F.count("*").alias("n_rows"))
    return tables.with_status(newest, "F").join(n, "test_id").select("test_id", "status", "n_rows")


@check("s23_report_rows", """
SELECT geo, metric, value FROM (
  SELECT geo, unnest(['n_rows', 'first_day', 'orders']) AS metric, unnest([CAST(count(*) AS VARCHAR), CAST(min(date) AS VARCHAR),
         CAST(sum(orders)::BIGINT AS VARCHAR)]) AS value FROM x_daily GROUP BY geo)
""")
def s23(spark, sf):
    from parity.common import daily

    report = daily(spark, sf).groupBy("geo").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_day"), F.sum("orders").alias("orders"))
    return tables.report_rows(report, "geo", ["n_rows", "first_day", "orders"])


@check("s24_markets_by_region", "SELECT geo, name, region FROM x_geos WHERE region IN ('ASIA', 'EUROPE')")
def s24(spark, sf):
    return tables.markets_in(geos(spark, sf), "region", ["ASIA", "EUROPE"]).select("geo", "name", "region")


view("x_zip3", """
SELECT substr(lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0'), 1, 3) AS zip3, min(CAST(c_nationkey AS VARCHAR)) AS geo
FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1
""")


def zip3(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 3 <> 0")
    return tables.zip3_table(c.select(
        F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0").alias("zip"),
        F.col("c_nationkey").cast("string").alias("geo")))


@check("s24_zip3_table", "SELECT * FROM x_zip3")
def s24b(spark, sf):
    return zip3(spark, sf)


@check("s25_adjacency_edges", """
SELECT DISTINCT src, dst FROM (
  SELECT CAST(s_nationkey AS VARCHAR) AS src, CAST(c_nationkey AS VARCHAR) AS dst FROM supplier JOIN customer ON s_suppkey = c_custkey)
WHERE src <> dst
""")
def s25(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    pairs = s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select(
        F.col("s_nationkey").cast("string").alias("geo"), F.col("c_nationkey").cast("string").alias("n"))
    return tables.edges_from_lists(pairs.groupBy("geo").agg(F.collect_set("n").alias("neighbours")))


# ---- J01–J04, J18 ---------------------------------------------------------------------------


@check("j01_zip_to_geo", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, z.geo, o_totalprice AS total_price
FROM x_rawzip JOIN x_zip3 z ON z.zip3 = substr(zip, 1, 3)
""")
def j01(spark, sf):
    o = commerce.normalise_orders(raw_orders(spark, sf))
    return lookups.map_zip_to_geo(o, zip3(spark, sf)).filter("geo IS NOT NULL").select("order_id", "geo", "total_price")


@check("j01_zip_coverage", """
SELECT count(*) AS n_rows, count(z.geo) AS n_mapped, round(count(z.geo) / count(*), 6) AS coverage,
       count(z.geo) / count(*) < 0.5 AS is_error FROM x_rawzip LEFT JOIN x_zip3 z ON z.zip3 = substr(zip, 1, 3)
""")
def j01b(spark, sf):
    o = commerce.normalise_orders(raw_orders(spark, sf))
    return rounded(lookups.mapping_coverage(lookups.map_zip_to_geo(o, zip3(spark, sf))))


@check("j02_market_names", """
SELECT user_id % 25 < 20 AS is_mapped, CASE WHEN user_id % 25 < 20 THEN CAST(user_id % 25 AS VARCHAR) END AS geo, count(*) AS n
FROM events GROUP BY 1, 2
""")
def j02(spark, sf):
    raw, names = _social(spark, sf)
    m = lookups.map_market_names(raw.withColumnRenamed("market_name", "name"), names)
    return m.groupBy(F.col("geo").isNotNull().alias("is_mapped"), "geo").agg(F.count("*").alias("n"))


@check("j03_platform_ids", """
SELECT geo, channel, count(*) AS n, round(sum(spend), 2) AS spend FROM x_events WHERE CAST(geo AS INTEGER) < 18 GROUP BY 1, 2
""")
def j03(spark, sf):
    e = spend_events(spark, sf).withColumn("platform_id", (F.col("geo").cast("int") + 200500).cast("string")).drop("geo")
    return rounded(lookups.map_platform_ids(e, _platform_ids(spark, sf)).groupBy("geo", "channel").agg(
        F.count("*").alias("n"), F.sum("spend").alias("spend")), 2)


view("x_shares", """
SELECT 'S' || (n_nationkey // 3) AS state, CAST(n_nationkey AS VARCHAR) AS geo, 1.0 / count(*) OVER (PARTITION BY n_nationkey // 3) AS weight
FROM nation WHERE n_nationkey < 15
""")


@check("j04_state_split", """
SELECT e.date, coalesce(s.geo, 'Unknown (' || e.state || ')') AS geo, round(sum(spend * coalesce(weight, 1)), 4) AS spend,
       round(sum(k * coalesce(weight, 1)), 4) AS impressions
FROM (SELECT date, spend, k, CASE WHEN CAST(geo AS INTEGER) // 3 = 7 THEN 'S0' ELSE 'S' || (CAST(geo AS INTEGER) // 3) END AS state
      FROM x_events) e LEFT JOIN x_shares s USING (state) GROUP BY 1, 2
""")
def j04(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey < 15")
    state = F.concat(F.lit("S"), F.floor(F.col("n_nationkey") / 3).cast("string"))
    size = n.groupBy(state.alias("state")).agg((1.0 / F.count("*")).alias("weight"))
    shares = n.select(state.alias("state"), F.col("n_nationkey").cast("string").alias("geo")).join(size, "state")
    e = spend_events(spark, sf).select("date", "spend", F.col("k").alias("impressions"),
                                       F.concat(F.lit("S"), F.floor(F.col("geo").cast("int") / 3).cast("string")).alias("region"))
    return rounded(lookups.split_states_to_geos(e, shares, {"S7": "S0"}, ["spend", "impressions"]), 4)


@check("j18_targeting_spec", """
SELECT test_id, cell, cell = 'holdout' AS negative, count(*) AS n_markets,
       string_agg(CAST(CAST(geo AS INTEGER) + 200500 AS VARCHAR), ',' ORDER BY CAST(CAST(geo AS INTEGER) + 200500 AS VARCHAR)) AS keys
FROM x_assign WHERE CAST(geo AS INTEGER) < 18 GROUP BY 1, 2
""")
def j18(spark, sf):
    from parity.common import assignment

    spec = lookups.targeting_spec(assignment(spark, sf), _platform_ids(spark, sf))
    return spec.select("test_id", "cell", "negative", F.size("markets").cast("bigint").alias("n_markets"),
                       F.array_join("markets.key", ",").alias("keys"))


# ---- scalar functions on table columns ------------------------------------------------------


@check("f07_channel_key", """
SELECT o_orderkey, replace(replace(replace(lower(o_orderpriority || ' - X Y-Z'), ' - ', '_'), '-', '_'), ' ', '_') AS channel FROM orders
""")
def f07(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.channel_key(F.concat("o_orderpriority", F.lit(" - X Y-Z"))).alias("channel"))


@check("f08_text_parts", """
SELECT p_partkey, substr(trim(p_name), 1, 3) AS prefix, trim(split_part(p_name, ' ', 1)) AS first_part,
       split_part(p_brand, '#', 2) AS last_part, substr(CAST(p_partkey AS VARCHAR), 1, 5) AS zip5,
       CASE WHEN p_partkey >= 100 THEN substr(CAST(p_partkey AS VARCHAR), 1, 3) END AS zip3 FROM part
""")
def f08(spark, sf):
    key = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", S.zip_prefix(F.col("p_name")).alias("prefix"), S.first_segment(F.col("p_name"), " ").alias("first_part"),
        S.last_segment(F.col("p_brand"), "#").alias("last_part"), S.zip5(key).alias("zip5"), S.zip_prefix(key).alias("zip3"))


_STATES = ("CT", "TX", "WA", "OH", "FL", "PR", "DE", "AZ")


@check("f09_state_region", """
SELECT region, count(*) AS n FROM (SELECT (CASE CAST(c_custkey % 8 AS INTEGER) WHEN 0 THEN 'Northeast' WHEN 1 THEN 'Southwest' WHEN 2 THEN 'West'
  WHEN 3 THEN 'Midwest' WHEN 4 THEN 'Southeast' WHEN 5 THEN 'Other' WHEN 6 THEN 'Northeast' ELSE 'West' END) AS region FROM customer) GROUP BY 1
""")
def f09(spark, sf):
    states = F.array(*[F.lit(s) for s in _STATES])
    state = F.element_at(states, (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf, "customer").select(S.region_of_state(state).alias("region")).groupBy("region").agg(F.count("*").alias("n"))


@check("f10_safe_divide", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_tax, 0), 4) AS or_null,
       round(CASE WHEN l_tax > 0 THEN l_extendedprice / l_tax ELSE 0 END, 4) AS or_zero,
       CASE WHEN l_tax <> 0 THEN round(l_extendedprice / l_tax, 4) ELSE 'nan'::DOUBLE END AS or_nan FROM lineitem
""")
def f10(spark, sf):
    a, b = F.col("l_extendedprice"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(S.null_if_undefined(a, b), 4).alias("or_null"),
        r(S.zero_if_undefined(a, b), 4).alias("or_zero"), r(S.nan_if_undefined(a, b), 4).alias("or_nan"))


@check("f11_clamp", """
SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity, 10), 40) AS quantity FROM lineitem
""")
def f11(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.clamp(F.col("l_quantity"), 10, 40).alias("quantity"))


@check("f13_next_monday", """
SELECT o_orderkey, CAST(d + CAST(8 - isodow(d) AS INTEGER) AS DATE) AS start_date,
       CAST(d + CAST(8 - isodow(d) + 7 * (o_orderkey % 12 + 1) AS INTEGER) AS DATE) AS end_date
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def f13(spark, sf):
    start = S.next_monday(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select(
        "o_orderkey", start.alias("start_date"), S.plus_weeks(start, F.col("o_orderkey") % 12 + 1).alias("end_date"))


@check("f14_local_days", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(DATE '2001-12-31' - CAST(o_orderdate AS DATE) + 1 AS INTEGER) AS days,
       strftime(o_orderdate, '%Y-%W') AS week FROM orders
""")
def f14(spark, sf):
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:59:59-08:00"))
    day = S.local_day(stamp)
    return table(spark, sf, "orders").select(
        "o_orderkey", day.alias("day"), S.inclusive_days(day, F.lit("2001-12-31").cast("date")).alias("days"), S.monday_week(day).alias("week"))


@check("f15_json_metadata", """
SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def f15(spark, sf):
    meta = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k")).alias("detail")))
    back = F.from_json(meta, "kind string, detail struct<k:bigint>")
    return table(spark, sf, "events").select("event_id", back.alias("m")).select("event_id", "m.kind", "m.detail.k")
