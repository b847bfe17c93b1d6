"""Full design of many planned tests at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.functions.scalars import next_monday, plus_weeks
from liftfield.operators import design, power, spillover
from liftfield.session import cut_lineage


@dataclass(frozen=True)
class DesignSettings:
    """Statistical settings of a design; defaults follow common practice for market tests."""

    alpha: float = 0.05
    power: float = 0.80
    min_weeks: int = 2
    max_weeks: int = 12
    min_cell: int = 5
    max_holdout_share: float = 0.50
    target_holdout_share: float = 0.25
    balance_tolerance: float = 0.10
    target_mde: float | None = None
    must_balance: bool = False
    n_candidates: int = 10_000
    n_simulations: int = 50

    def __post_init__(self) -> None:
        for name in ("alpha", "power", "max_holdout_share", "target_holdout_share"):
            if not 0.0 < getattr(self, name) < 1.0:
                raise ValueError(f"{name} must lie in (0, 1)")
        if not 1 <= self.min_weeks <= self.max_weeks:
            raise ValueError("test length bounds are out of order")


def auto_design(
    daily: DataFrame, markets: DataFrame, edges: DataFrame, today, settings: DesignSettings = DesignSettings(),
    campaigns: DataFrame | None = None, campaign_spend: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(designs, assignment) for every test_id in ``daily`` (test_id, geo, date, revenue) and ``markets``.

    ``markets`` is the matching table per test. Power and the back-test use the markets left after the buffer;
    tests with fewer than two full cells are left out. Tests named in ``campaigns`` (test_id, campaign_id) are about those
    campaigns: their markets are matched on the spend of them in ``campaign_spend`` (geo, campaign_id, spend). A test that
    re-randomisation can't serve gets matched pairs.
    """
    s = settings
    if campaigns is not None and campaign_spend is not None:
        markets = design.campaign_scope(markets, campaign_spend, campaigns)
    enough = markets.groupBy("test_id").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * s.min_cell).select("test_id")
    daily, markets = cut_lineage(daily.join(enough, "test_id", "left_semi")), cut_lineage(markets.join(enough, "test_id", "left_semi"))
    variance = power.variance_components(daily)
    sizes = design.best_holdout_size(
        variance, ["test_id"], target_mde=s.target_mde or 0.15, min_cell=s.min_cell, max_share=s.max_holdout_share,
        target_share=s.target_holdout_share, weeks=s.max_weeks)
    planned = markets.join(sizes.select("test_id", "n_holdout"), "test_id")
    assigned = cut_lineage(design.assigned_with_fallback(planned, s.n_candidates, tolerance=s.balance_tolerance, must_balance=s.must_balance))
    cells = assigned.select("test_id", "geo", "cell")
    buffered = cut_lineage(spillover.geographic_buffer(edges, cells, s.min_cell))
    kept = spillover.analysis_cells(buffered)
    counts = kept.groupBy("test_id").agg(
        F.count_if(F.col("cell") == "treatment").alias("n_treatment"), F.count_if(F.col("cell") == "holdout").alias("n_holdout"))
    result = cut_lineage(power.power_result(
        variance.join(counts, "test_id"), ["test_id"], s.target_mde, s.min_weeks, s.max_weeks, s.alpha, s.power))
    panel = daily.join(kept, ["test_id", "geo"])
    lengths = result.select("test_id", (F.col("duration_weeks") * 7).alias("post_days"))
    tested = power.backtest_summary(power.backtest_power(panel, lengths, s.n_simulations, s.alpha), counts).select("test_id", "sim_power", "fpr", "power_score")
    hold = assigned.groupBy("test_id").agg(F.sum(F.when(F.col("cell") == "holdout", F.col("total_revenue"))).alias("holdout_revenue"))
    facts = result.join(tested, "test_id", "left").join(hold, "test_id")
    facts = facts.fillna(0.0, ["sim_power", "fpr", "power_score"])
    judged = design.feasibility(facts)
    balance = design.balance_scores(assigned, ["test_id"], tolerance=s.balance_tolerance)
    risk = spillover.spillover_risk(edges, cells).select("test_id", "risk_score", "risk_level")
    start = next_monday(F.lit(today).cast("date"))
    rows = judged.join(balance, "test_id").join(risk, "test_id").join(
        sizes.select("test_id", F.col("n_treatment").alias("n_treatment_all"), F.col("n_holdout").alias("n_holdout_all")), "test_id")
    rows = rows.join(assigned.groupBy("test_id").agg(F.first("method").alias("method")), "test_id")
    scope = campaigns.groupBy("test_id").agg(F.sort_array(F.collect_set("campaign_id")).alias("campaign_ids")) if campaigns is not None else None
    rows = rows.join(scope, "test_id", "left") if scope is not None else rows.withColumn("campaign_ids", F.lit(None).cast("array<string>"))
    designs = rows.select(
        "test_id", F.lit("designed").alias("status"), "method", F.when(F.col("campaign_ids").isNull(), "channel").otherwise("campaign").alias("scope"),
        F.coalesce("campaign_ids", F.array().cast("array<string>")).alias("campaign_ids"), start.alias("start_date"), plus_weeks(start, F.col("duration_weeks")).alias("end_date"),
        "duration_weeks", "n_treatment_all", "n_holdout_all", F.col("n_treatment").alias("n_treatment_analysed"),
        F.col("n_holdout").alias("n_holdout_analysed"), "mde", "power", "sim_power", "fpr", "power_score", "cohen_d", "balance_score",
        "is_balanced", "risk_score", "risk_level", "is_feasible", "blockers", "warnings", "opportunity_cost")
    return designs, buffered
