"""Incremental revenue, iROAS, incremental order ratio, cost per incremental order, recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPILL_DECAY = 0.20


def cell_totals(panel: DataFrame, value: str = "revenue", keys: list[str] = ["test_id"]) -> DataFrame:
    """Post-period totals, means per market-day, market and day counts by cell."""
    post = panel.filter("period = 'post'")
    return post.groupBy(*keys, "cell").agg(
        F.sum(value).alias("total"), F.avg(value).alias("avg_per_geo_day"),
        F.count_distinct("geo").alias("n_geos"), F.count_distinct("date").alias("n_days"))


def organic_baseline(totals: DataFrame, tests: DataFrame, assignment: DataFrame) -> DataFrame:
    """Holdout mean × treatment markets × test days, next to both cells' totals."""
    size = assignment.groupBy("test_id").agg(F.count_if(F.col("cell") == "treatment").alias("n_treatment"))
    by = totals.groupBy("test_id").agg(
        F.max(F.when(F.col("cell") == "treatment", F.col("total"))).alias("treatment_revenue"),
        F.max(F.when(F.col("cell") == "holdout", F.col("total"))).alias("holdout_revenue"),
        F.max(F.when(F.col("cell") == "holdout", F.col("avg_per_geo_day"))).alias("holdout_avg"))
    days = F.datediff("end_date", "start_date") + 1
    return by.join(size, "test_id").join(tests, "test_id").select(
        "test_id", "treatment_revenue", "holdout_revenue", F.col("n_treatment"),
        days.cast("bigint").alias("n_days"), (F.col("holdout_avg") * F.col("n_treatment") * days).alias("organic_baseline"))


def incremental_revenue(results: DataFrame, scale: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """Lift × treatment markets × days; interval through the baseline implied by the relative lift."""
    rows = results.join(scale.select(*keys, F.col("n_treatment").alias("_nt"), F.col("n_days").alias("_nd")), keys)
    total = F.col("absolute_lift") * F.col("_nt") * F.col("_nd")
    base = F.when(F.abs("relative_lift") > 1e-6, F.col("absolute_lift") / F.col("relative_lift")).otherwise(0.0) * F.col("_nt") * F.col("_nd")
    bound = lambda c: F.when(base > 0, F.col(c) * base).otherwise(total)
    return rows.select(
        *keys, total.alias("incremental_revenue"), bound("lift_lower_ci").alias("incremental_lower"),
        bound("lift_upper_ci").alias("incremental_upper"))


def treatment_spend(spend: DataFrame, tests: DataFrame, assignment: DataFrame) -> DataFrame:
    """Spend of treatment markets inside the test period; tests without any keep a 0."""
    days = tests.select("test_id", F.explode(F.sequence("start_date", "end_date")).alias("date"))
    daily = spend.groupBy("date", "geo").agg(F.sum("spend").alias("spend"))  # small before it meets the tests
    rows = daily.join(days, "date").join(
        assignment.filter("cell = 'treatment'").select("test_id", "geo"), ["test_id", "geo"])
    got = rows.groupBy("test_id").agg(F.sum("spend").alias("spend"))
    return tests.select("test_id").join(got, "test_id", "left").fillna(0.0, ["spend"])


def iroas(incremental: DataFrame, spend: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """Incremental revenue over treatment spend with its interval; all zero without spend."""
    rows = incremental.join(spend, keys, "left").fillna(0.0, ["spend"])
    paid = F.col("spend") > 0
    zero = lambda c: F.when(paid, c).otherwise(0.0)
    return rows.select(
        *keys, zero(F.col("incremental_revenue")).alias("incremental_revenue"), zero(F.col("spend")).alias("total_spend"),
        zero(F.col("incremental_revenue") / F.col("spend")).alias("iroas"),
        zero(F.col("incremental_lower") / F.col("spend")).alias("iroas_lower"),
        zero(F.col("incremental_upper") / F.col("spend")).alias("iroas_upper"))


ORDER_COLUMNS = ("orders", "store_orders", "total_orders")


def pick_orders_column(columns: list[str]) -> str | None:
    return next((c for c in ORDER_COLUMNS if c in columns), None)


def incremental_order_ratio(panel: DataFrame, scale: DataFrame, spend: DataFrame, attributed: DataFrame | None = None) -> DataFrame:
    """Incremental orders (mean of market means, floored at 0), orders per attributed conversion, cost per order."""
    column = pick_orders_column(panel.columns)
    if column is None:
        raise ValueError("the panel has no orders column")
    means = panel.filter("period = 'post'").groupBy("test_id", "cell", "geo").agg(F.avg(column).alias("m"))
    gap = means.groupBy("test_id").agg(
        F.avg(F.when(F.col("cell") == "treatment", F.col("m"))).alias("t"),
        F.avg(F.when(F.col("cell") == "holdout", F.col("m"))).alias("h"))
    rows = gap.join(scale.select("test_id", "n_treatment", "n_days"), "test_id").join(spend, "test_id")
    rows = rows.join(attributed, "test_id", "left") if attributed is not None else rows.withColumn("attributed", F.lit(0.0))
    inc = F.greatest(F.coalesce((F.col("t") - F.col("h")) * F.col("n_treatment") * F.col("n_days"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("incremental_orders", F.when(F.col("spend") > 0, inc).otherwise(0.0))
    some = F.col("incremental_orders") > 0
    return rows.select(
        "test_id", "incremental_orders",
        F.when(some & (F.col("attributed") > 0), F.col("incremental_orders") / F.col("attributed")).otherwise(0.0).alias("incremental_order_ratio"),
        F.when(some, F.col("spend") / F.col("incremental_orders")).otherwise(0.0).alias("cpia"))


def unpivot_metrics(panel: DataFrame, metrics: list[str]) -> DataFrame:
    """Metric columns to rows, so every estimator can be keyed by metric as well."""
    ids = [c for c in panel.columns if c not in metrics]
    typed = panel.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(ids, metrics, "metric", "value")


def halo(platforms: DataFrame, metric: str = "marketplace") -> DataFrame:
    """(test_id, marketplace_lift, marketplace_significant) out of the result rows of each platform."""
    return platforms.filter(F.col("metric") == metric).select(
        "test_id", F.col("relative_lift").alias("marketplace_lift"), F.col("is_significant").alias("marketplace_significant"))


def spillover_adjusted(results: DataFrame, risk: DataFrame, minimum: float = 0.1) -> DataFrame:
    """Lift and interval × 1/(1 − 0.2·(1 − clean)) where the risk exceeds ``minimum``."""
    rows = results.join(risk.select("test_id", "risk_score", "clean_holdout_share"), "test_id", "left")
    adjust = F.col("risk_score") > minimum
    factor = F.when(
        adjust & (F.col("clean_holdout_share") < 1.0), 1.0 / (1.0 - (1.0 - F.col("clean_holdout_share")) * SPILL_DECAY)
    ).otherwise(1.0)
    scaled = rows.withColumn("spillover_factor", factor)
    for c in ("absolute_lift", "relative_lift", "lift_lower_ci", "lift_upper_ci"):
        scaled = scaled.withColumn(c, F.col(c) * F.col("spillover_factor"))
    return scaled.drop("risk_score", "clean_holdout_share")


def recommendations(facts: DataFrame) -> DataFrame:
    """One row per piece of advice from (is_significant, iroas, marketplace_lift, marketplace_significant)."""
    codes = [
        F.when(F.col("is_significant"), "significant_lift").otherwise("not_significant"),
        F.when(F.col("iroas") >= 3.0, "iroas_excellent").when(F.col("iroas") >= 1.0, "iroas_profitable")
        .when(F.col("iroas") > 0, "iroas_below_breakeven").otherwise("iroas_negative"),
        F.when((F.col("marketplace_lift") > 0) & F.col("marketplace_significant"), "halo_significant")
        .when(F.col("marketplace_lift") > 0, "halo_possible"),
    ]
    return facts.select("test_id", F.posexplode(F.array_compact(F.array(*codes))).alias("position", "code"))
