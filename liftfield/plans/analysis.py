"""Full analysis of many tests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.operators import causal, quality, response, returns, spillover, structural, synth, validation
from liftfield.operators.panel import TREATED_UNIT, aligned_series, median_split, relabel_periods, split_points
from liftfield.session import cut_lineage


def estimator_results(panel: DataFrame, value: str = "revenue", alpha: float = 0.05, n_boot: int = 2000, fitted: DataFrame | None = None) -> DataFrame:
    """Rows of all estimators; a test too short for one simply lacks its row."""
    if fitted is None:
        fitted = synth.ascm_series(synth.unit_series(panel, value))
    parts = [
        synth.ascm_results(fitted, alpha=alpha, n_perm=n_boot),
        structural.structural_results(structural.structural_series(aligned_series(panel, value)), alpha),
        causal.difference_in_differences(panel, ["test_id"], value, alpha, n_boot),
    ]
    return cut_lineage(causal.stack_results(parts))


def halves_test(panel: DataFrame, tests: DataFrame, value: str = "revenue", alpha: float = 0.05, n_boot: int = 2000) -> DataFrame:
    """First against second half of the pre period: synthetic control, else difference-in-differences, else a pass."""
    halves = relabel_periods(panel, median_split(panel)).drop("split")
    ascm = synth.ascm_results(synth.ascm_series(synth.unit_series(halves, value)), alpha=alpha, n_perm=n_boot)
    did = causal.difference_in_differences(halves, ["test_id"], value, alpha, n_boot)
    return halves_rows(ascm, did, tests, alpha)


def halves_rows(ascm: DataFrame, did: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    rows = tests.select("test_id").join(ascm.select("test_id", F.col("p_value").alias("p1")), "test_id", "left").join(
        did.select("test_id", F.col("p_value").alias("p2")), "test_id", "left")
    p = F.coalesce("p1", "p2", F.lit(1.0))
    method = F.when(F.col("p1").isNotNull(), "ascm").when(F.col("p2").isNotNull(), "did").otherwise("skipped")
    return rows.select("test_id", method.alias("method"), p.alias("p_value"), (p > alpha).alias("is_passed"))


def placebo_in_space(fitted: DataFrame, alpha: float = 0.05, n_perm: int = 2000) -> DataFrame:
    """Every donor as target; its p compares with the placebo effects of the other donors."""
    return space_rows(synth.ascm_results(fitted, alpha=alpha, n_perm=n_perm, targets="donors"))


def space_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "test_id", F.lit("in_space").alias("placebo_type"), "target", F.col("relative_lift").alias("estimated_effect"), "p_value",
        F.col("is_significant").alias("is_false_positive"))


def stacked_variants(panel: DataFrame, n_splits: int = 5) -> DataFrame:
    """The panel once for each way in which a report looks at it, told apart by ``variant``: raw, winsorised, halves of the pre
    period, and a made-up start date for each placebo split. Written once.
    """
    columns = ["test_id", "geo", "cell", "date", "period", "revenue"]
    raw = panel.select(*columns)
    parts = {"raw": raw, "winsorised": quality.winsorise(panel).select(*columns)}
    parts["halves"] = relabel_periods(raw, median_split(panel)).select(*columns)
    out = None
    for name, df in parts.items():
        out = df.withColumn("variant", F.lit(name)) if out is None else out.unionByName(df.withColumn("variant", F.lit(name)))
    splits = relabel_periods(raw, split_points(panel, n_splits))
    return cut_lineage(out.unionByName(splits.select(*columns, F.concat(F.lit("split-"), F.col("split").cast("string")).alias("variant"))))


def validate(results: DataFrame, tests: DataFrame, ascm: DataFrame, did: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Halves test, placebos in time and space, agreement and trust score of every test with a result.

    ``ascm`` and ``did`` are the result rows of all variants and targets.
    """
    at = lambda df, v: df.filter(F.col("variant") == v)
    treated = F.col("target") == TREATED_UNIT
    aa = halves_rows(at(ascm, "halves").filter(treated), at(did, "halves"), tests, alpha)
    time = did.filter(F.col("variant").startswith("split-")).select("test_id", F.col("is_significant").alias("is_false_positive"))
    space = space_rows(at(ascm, "raw").filter(~treated)).select("test_id", "is_false_positive")
    fpr = validation.placebo_summary(time.unionByName(space), tests)
    ensemble = causal.weighted_ensemble(results)
    facts = ensemble.select("test_id", F.col("l2_imbalance").alias("l2"), F.col("r_squared").alias("r2"))
    facts = facts.join(aa.select("test_id", F.col("is_passed").alias("aa_passed"), F.col("p_value").alias("aa_p_value")), "test_id")
    facts = facts.join(fpr.select("test_id", F.col("false_positive_rate").alias("fpr"), "n_placebos"), "test_id")
    facts = facts.join(validation.estimator_agreement(results), "test_id")
    return validation.trust_score(facts)


def platform_lifts(panel: DataFrame, platforms: list[str], n_boot: int = 2000) -> DataFrame:
    """Difference-in-differences of each platform's revenue, all platforms and tests in one pass: rows (test_id, metric, …)."""
    return causal.difference_in_differences(returns.unpivot_metrics(panel, platforms), ["test_id", "metric"], "value", n_boot=n_boot)


def spend_response(panel: DataFrame, tests: DataFrame, spend: DataFrame, money: DataFrame) -> DataFrame:
    """Curve of incremental revenue over daily spend of each test with enough markets, scaled to its measured return."""
    days = tests.select("test_id", F.explode(F.sequence("start_date", "end_date")).alias("date"))
    by_day = spend.groupBy("date", "geo").agg(F.sum("spend").alias("spend")).join(days, "date")
    points = cut_lineage(response.response_points(response.market_levels(panel, by_day)))
    fitted = response.calibrate(response.fit_response(points), points, money.select("test_id", "iroas"))
    return response.response_summary(fitted, points).select(
        "test_id", "optimal_spend", "spend_change_pct", F.col("direction").alias("spend_direction"), F.col("r_squared").alias("response_r_squared"))


def analyse_tests(
    daily: DataFrame, tests: DataFrame, assignment: DataFrame, spend: DataFrame, edges: DataFrame, attributed: DataFrame | None = None,
    n_boot: int = 2000, platforms: tuple[str, ...] = (),
) -> DataFrame:
    """One report row per test.

    The panel is written once, then once more for its variants: every estimator runs a single time, over all variants of all
    tests, so the number of tests only scales the data. ``platforms`` names columns of ``daily`` with the revenue of
    each platform; their lifts are reported, and that of "marketplace" decides on the halo advice.
    """
    from liftfield.operators.panel import test_panel

    panel = test_panel(daily, tests, assignment)
    keys = ["test_id", "variant"]
    variants = stacked_variants(panel)
    did = cut_lineage(causal.difference_in_differences(variants, keys, n_boot=n_boot))
    fitted = synth.ascm_series(synth.unit_series(variants.filter(F.col("variant").isin("raw", "halves")), keys=keys), keys)
    wanted = (F.col("penalty") == "fixed") | (F.col("variant") == "raw") | (F.col("target") == TREATED_UNIT)
    ascm = cut_lineage(synth.ascm_results(fitted.filter(wanted), keys, n_perm=n_boot, targets="all"))
    raw = F.col("variant") == "raw"
    results = cut_lineage(causal.stack_results([
        ascm.filter(raw & (F.col("target") == TREATED_UNIT)), structural.structural_results(structural.structural_series(aligned_series(panel))), did.filter(raw)]))
    ensemble = cut_lineage(causal.weighted_ensemble(results))
    findings = quality.anomaly_report(panel, assignment).groupBy("test_id").agg(
        F.count_if(F.col("severity") == "blocker").alias("n_data_blockers"), F.count_if(F.col("severity") == "warning").alias("n_data_warnings"))
    robust = quality.compare_winsorised(ensemble, did.filter(F.col("variant") == "winsorised")).select("test_id", "divergence", F.col("advice").alias("winsor_advice"))
    trust = validate(results, tests, ascm, did).select(
        "test_id", "aa_passed", F.col("fpr").alias("false_positive_rate"), "agreement", "trust_score", "is_trustworthy")
    risk = spillover.spillover_risk(edges, assignment)
    adjusted = cut_lineage(returns.spillover_adjusted(ensemble, risk))
    size = assignment.groupBy("test_id").agg(F.count_if(F.col("cell") == "treatment").alias("n_treatment"))
    scale = size.join(tests.select("test_id", (F.datediff("end_date", "start_date") + 1).alias("n_days")), "test_id")
    paid = cut_lineage(returns.treatment_spend(spend, tests, assignment))
    money = cut_lineage(returns.iroas(returns.incremental_revenue(adjusted, scale), paid))
    orders = returns.incremental_order_ratio(panel, scale, paid, attributed)
    totals = returns.organic_baseline(returns.cell_totals(panel), tests, assignment).drop("n_treatment", "n_days")
    curve = spend_response(panel, tests, spend, money)
    if platforms:
        lifts = cut_lineage(platform_lifts(panel, list(platforms), n_boot))
        halo = returns.halo(lifts)
        breakdown = lifts.groupBy("test_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
            "metric", F.struct("absolute_lift", "relative_lift", "p_value", "is_significant").alias("v"))))).alias("platform_lifts"))
    else:
        halo = tests.select("test_id", F.lit(None).cast("double").alias("marketplace_lift"), F.lit(False).alias("marketplace_significant"))
        breakdown = tests.select("test_id", F.lit(None).cast("map<string, struct<absolute_lift: double, relative_lift: double, p_value: double, is_significant: boolean>>").alias("platform_lifts"))
    told = adjusted.select("test_id", "is_significant").join(halo, "test_id", "left").join(money.select("test_id", "iroas"), "test_id")
    advice = returns.recommendations(told).groupBy("test_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: x["code"]).alias("recommendations"))
    out = adjusted.select(
        "test_id", "absolute_lift", "relative_lift", "lift_lower_ci", "lift_upper_ci", "p_value", "is_significant", "l2_imbalance", "r_squared",
        "n_methods", "spillover_factor")
    for part in (trust, robust, money, orders, totals, curve, breakdown, advice):
        out = out.join(part, "test_id", "left")
    return out.join(findings, "test_id", "left").fillna(0, ["n_data_blockers", "n_data_warnings"])
