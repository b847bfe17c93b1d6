"""Ad-platform spend rows: one normaliser per landed layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.functions.scalars import last_segment, zero_if_undefined
from liftfield.operators.lookups import map_market_names, map_platform_ids
from liftfield.sources.landed import number, whole

MICROS = 1_000_000.0
CENTS = 100.0


def social_spend_by_market(raw: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insight rows by market name → (mapped rows, distinct unmapped names with their row counts)."""
    typed = raw.select(
        F.to_date("date_start").alias("date"),
        F.col("market_name").alias("name"),
        number("spend").alias("spend"),
        whole("impressions").alias("impressions"),
        whole("clicks").alias("clicks"),
    )
    mapped = map_market_names(typed, names)
    good = mapped.filter("geo IS NOT NULL").select("date", "geo", "name", "spend", "impressions", "clicks")
    lost = mapped.filter("geo IS NULL").groupBy("name").agg(F.count("*").alias("n_rows"))
    return good, lost


def video_spend_by_market(raw: DataFrame, id_map: DataFrame) -> DataFrame:
    """Micro-unit cost, market id from the last path segment, cost per view 0 when nobody viewed."""
    typed = raw.select(
        F.to_date("date").alias("date"),
        last_segment(F.col("geo_resource")).alias("platform_id"),
        (number("cost_micros") / MICROS).alias("spend"),
        whole("impressions").alias("impressions"),
        whole("views").alias("views"),
        number("view_rate").alias("view_rate"),
        whole("clicks").alias("clicks"),
    )
    return map_platform_ids(typed, id_map).select(
        "date", "geo", "spend", "impressions", "views", "view_rate", "clicks",
        zero_if_undefined(F.col("spend"), F.col("views")).alias("cost_per_view"),
    )


def region_video_spend(raw: DataFrame) -> DataFrame:
    """State-level short-video rows with missing numbers as 0."""
    return raw.select(
        F.to_date("date").alias("date"),
        F.coalesce("region", F.lit("")).alias("region"),
        number("spend").alias("spend"),
        whole("impressions").alias("impressions"),
        whole("video_views").alias("video_views"),
        whole("video_completions").alias("video_completions"),
    )


def region_spend_for_objective(raw: DataFrame, campaigns: DataFrame, objective: str) -> DataFrame:
    """Only campaigns of one objective (any case), summed per day and region."""
    wanted = campaigns.filter(F.upper("objective") == objective.upper()).select("campaign_id")
    kept = raw.join(wanted, "campaign_id", "left_semi")
    return region_video_spend(kept).groupBy("date", "region").agg(
        *[F.sum(c).alias(c) for c in ("spend", "impressions", "video_views", "video_completions")]
    )


def region_pin_spend(raw: DataFrame) -> DataFrame:
    """Region rows whose spend is in micro-dollars."""
    return raw.select(
        F.to_date("date").alias("date"),
        "region",
        (number("spend_in_micro_dollar") / MICROS).alias("spend"),
        *[whole(c).alias(c) for c in ("impressions", "clicks", "saves", "pin_clicks")],
    )


def national_daily(df: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """Sum of the measures per day over all places."""
    return df.groupBy("date").agg(*[F.sum(m).alias(m) for m in measures])


def app_network_daily(raw: DataFrame) -> DataFrame:
    """National rows keyed by ``day``, else ``date``; rows with neither are skipped."""
    day = F.coalesce(F.nullif(F.col("day"), F.lit("")), F.nullif(F.col("date"), F.lit("")))
    typed = raw.select(
        F.to_date(F.substring(day, 1, 10)).alias("date"),
        number("cost").alias("spend"),
        whole("impressions").alias("impressions"),
        whole("clicks").alias("clicks"),
        whole("conversions").alias("installs"),
    ).filter("date IS NOT NULL")
    return national_daily(typed, ("spend", "impressions", "clicks", "installs"))


def tv_airings(raw: DataFrame) -> DataFrame:
    """TV rows per market and placement."""
    return raw.select(
        F.to_date("date").alias("date"),
        F.col("market_code").cast("string").alias("geo"),
        F.col("market_name").alias("name"),
        number("spend").alias("spend"),
        number("grps").alias("grps"),
        whole("impressions").alias("impressions"),
        whole("airings").alias("airings"),
        F.coalesce("placement_type", F.lit("")).alias("placement_type"),
    )


def campaign_dimension(raw: DataFrame, scale: float) -> DataFrame:
    """Campaigns with the budget scaled out of cents (100) or micros (1,000,000)."""
    return raw.select(
        F.col("id").cast("string").alias("campaign_id"),
        "name",
        "status",
        F.coalesce("objective", F.lit("")).alias("objective"),
        (number("budget") / float(scale)).alias("budget"),
    )
