"""Orders, marketplace orders and shop sales: raw rows to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.functions.scalars import local_day, zip5
from liftfield.sources.landed import number, whole

ORDER_JSON = (
    "id bigint, created_at string, total_price string, subtotal_price string, financial_status string, "
    "line_items array<struct<id:bigint>>, shipping_address struct<zip:string,province_code:string,city:string>"
)
MARKETPLACE_JSON = (
    "order_id string, purchase_date string, order_status string, order_total struct<Amount:string,CurrencyCode:string>, "
    "shipping_address struct<PostalCode:string,StateOrRegion:string,City:string>, items bigint"
)
SHIPPED_STATUSES = ("Shipped", "Delivered")
DEFAULT_COMMISSION_SHARE = 0.15


def normalise_orders(raw: DataFrame) -> DataFrame:
    """Typed order rows; the day is the shop's local day, a missing address becomes blanks."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        F.col("id").cast("string").alias("order_id"),
        "created_at",
        local_day(F.col("created_at")).alias("date"),
        number("total_price").alias("total_price"),
        number("subtotal_price").alias("subtotal_price"),
        zip5(F.col("shipping_address.zip")).alias("shipping_zip"),
        blank("shipping_address.province_code").alias("shipping_state"),
        blank("shipping_address.city").alias("shipping_city"),
        F.coalesce(F.size("line_items"), F.lit(0)).cast("bigint").alias("line_items_count"),
        "financial_status",
    ).withColumn("line_items_count", F.greatest("line_items_count", F.lit(0).cast("bigint")))


def normalise_marketplace(raw: DataFrame) -> DataFrame:
    """Shipped and delivered marketplace orders with a nested total."""
    return raw.filter(F.col("order_status").isin(*SHIPPED_STATUSES)).select(
        "order_id",
        local_day(F.col("purchase_date")).alias("date"),
        number("order_total.Amount").alias("total"),
        zip5(F.col("shipping_address.PostalCode")).alias("shipping_zip"),
        F.coalesce("shipping_address.StateOrRegion", F.lit("")).alias("shipping_state"),
        whole("items").alias("items"),
        "order_status",
    )


def zip_coverage(orders: DataFrame) -> DataFrame:
    """Rows, rows with a usable zip (3 characters or more) and the percentage."""
    usable = (F.length("shipping_zip") >= 3).cast("int")
    return orders.agg(
        F.count("*").alias("n_orders"),
        F.coalesce(F.sum(usable), F.lit(0)).cast("bigint").alias("n_with_zip"),
        F.coalesce(F.avg(usable.cast("double")) * 100.0, F.lit(0.0)).alias("zip_coverage_pct"),
    )


def normalise_shop_sales(raw: DataFrame, column: str = "fields") -> DataFrame:
    """Shop sales from key/value rows. An *absent* commission defaults to 15 % of sales, a null one is 0."""
    get = lambda k: F.element_at(F.col(column), k)
    gmv = number(get("gmv"))
    given = F.map_contains_key(F.col(column), "affiliate_commission")
    commission = F.when(given, number(get("affiliate_commission"))).otherwise(gmv * DEFAULT_COMMISSION_SHARE)
    return raw.select(
        F.to_date(F.substring(get("date"), 1, 10)).alias("date"),
        gmv.alias("gmv"),
        whole(get("orders")).alias("orders"),
        whole(get("units_sold")).alias("units_sold"),
        commission.alias("affiliate_commission"),
        whole(get("creator_count")).alias("creator_count"),
        commission.alias("estimated_spend"),
    )
