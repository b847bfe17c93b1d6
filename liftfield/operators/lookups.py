"""Market lookups: zip prefix, market name, platform id, state shares, targeting specs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.functions.scalars import first_segment, zip_prefix


def map_zip_to_geo(orders: DataFrame, zip3: DataFrame, column: str = "shipping_zip") -> DataFrame:
    """Left join on the 3-character prefix; short or unknown codes keep a NULL market."""
    return orders.withColumn("zip3", zip_prefix(F.col(column))).join(zip3, "zip3", "left")


def mapping_coverage(mapped: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Rows, mapped rows, share, and whether the share is below the error line."""
    share = F.coalesce(F.avg(F.col("geo").isNotNull().cast("double")), F.lit(0.0))
    return mapped.agg(
        F.count("*").alias("n_rows"), F.count("geo").alias("n_mapped"), share.alias("coverage")
    ).withColumn("is_error", F.col("coverage") < minimum)


def map_market_names(df: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Exact name, lowered name, text before the first comma, that text lowered — first hit wins."""
    exact = names.groupBy("name").agg(F.min("geo").alias("geo"))
    lowered = names.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("geo").alias("geo"))
    raw = F.col(column)
    steps = [
        (exact, raw),
        (lowered, F.lower(F.trim(raw))),
        (exact, first_segment(raw)),
        (lowered, F.lower(first_segment(raw))),
    ]
    out = df
    for i, (dim, key) in enumerate(steps):
        side = dim.select(F.col("name").alias(f"_n{i}"), F.col("geo").alias(f"_g{i}"))
        out = out.join(side, key == F.col(f"_n{i}"), "left")
    hit = F.coalesce(*[F.col(f"_g{i}") for i in range(4)])
    return out.select(*df.columns, hit.alias("geo"))


def map_platform_ids(df: DataFrame, id_map: DataFrame) -> DataFrame:
    """Inner join on the platform's own market id; unmapped rows drop."""
    return df.join(id_map, "platform_id")


def split_states_to_geos(
    df: DataFrame, shares: DataFrame, aliases: dict[str, str], measures: list[str], state: str = "region"
) -> DataFrame:
    """State totals spread over markets by population share.

    States without shares keep their total in an ``Unknown (state)`` bucket, so nothing is lost.
    """
    name = F.col(state)
    for alias, target in aliases.items():
        name = F.when(F.col(state) == alias, target).otherwise(name)
    named = df.withColumn("_state", name)
    side = shares.select(F.col("state").alias("_state"), F.col("geo").alias("_geo"), "weight")
    spread = named.join(side, "_state", "left")
    geo = F.coalesce("_geo", F.concat(F.lit("Unknown ("), F.col("_state"), F.lit(")")))
    weight = F.coalesce("weight", F.lit(1.0))
    return spread.groupBy("date", geo.alias("geo")).agg(*[F.sum(F.col(m) * weight).alias(m) for m in measures])


def targeting_spec(assignment: DataFrame, id_map: DataFrame, market_type: str = "geo_market") -> DataFrame:
    """Per test and cell: platform keys to include (treatment) or exclude (holdout), unmapped skipped."""
    rows = assignment.join(id_map, "geo")
    item = F.struct(F.col("platform_id").alias("key"), F.lit(market_type).alias("market_type"))
    return rows.groupBy("test_id", "cell").agg(
        F.sort_array(F.collect_list(item)).alias("markets"),
        F.bool_and(F.col("cell") == "holdout").alias("negative"),
    )
