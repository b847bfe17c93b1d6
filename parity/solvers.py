"""Synthetic control, structural series and the whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.operators import budget, structural, synth
from liftfield.operators.panel import aligned_series
from liftfield.plans import analysis, design
from parity import design as PD
from parity.causal import did_views
from parity.common import assignment, check, daily, market_daily, panel, per_test, rounded, spend_daily, tests_table, view


did_views("h", "x_halves", "test_id")


def series(spark, sf):
    return synth.unit_series(panel(spark, sf, "weekly"))


@check("c05_scm_weights", """
SELECT test_id, target, donor, round(weight, 4) AS weight FROM (SELECT test_id, target, unnest(donors) AS donor, unnest(w) AS weight FROM x_scw_w WHERE target = '*treatment*') WHERE weight > 0.0005
""")
def c05(spark, sf):
    return rounded(synth.scm_weights(series(spark, sf)).where("weight > 0.0005").drop("loss", "gap"), 4)


@check("c05_scm_optimality", """
SELECT test_id, target, round(list_sum(w), 9) AS weight_sum, list_min(w) >= 0 AS is_feasible, round(loss / 1e6, 3) AS loss, true AS is_least FROM x_scw_w
""")
def c05b(spark, sf):
    """All targets: weights are a simplex point, the loss equals the twin's and the duality gap proves it least."""
    w = synth.scm_weights(series(spark, sf), placebos=True)
    return rounded(w.groupBy("test_id", "target").agg(
        F.sum("weight").alias("weight_sum"), (F.min("weight") >= 0).alias("is_feasible"), (F.first("loss") / 1e6).alias("loss"),
        (F.first("gap") <= 1e-6 * F.first("loss")).alias("is_least")), 3, weight_sum=9)


ASCM_SQL = """round(absolute_lift, 2) AS absolute_lift, round(relative_lift, 6) AS relative_lift, round(lift_lower_ci, 6) AS lift_lower_ci,
 round(lift_upper_ci, 6) AS lift_upper_ci, round(se, 2) AS se, round(p_value, 6) AS p_value, is_significant, round(cohen_d, 6) AS cohen_d,
 round(lift_likelihood, 6) AS lift_likelihood, round(l2_imbalance, 6) AS l2_imbalance, round(r_squared, 6) AS r_squared, round(baseline, 2) AS baseline"""


@check("c06_ascm", f"SELECT test_id, target, method, {ASCM_SQL}, n_placebos FROM x_scr_w WHERE target = '*treatment*'")
def c06(spark, sf):
    return rounded(synth.ascm_results(synth.ascm_series(series(spark, sf))), 6, absolute_lift=2, se=2, baseline=2)


@check("c08_placebo_effects", "SELECT test_id, target, round(effect, 2) AS effect FROM x_scp_w")
def c08(spark, sf):
    return rounded(synth.placebo_effects(synth.ascm_series(series(spark, sf))), 2)


@check("t02_top_donors", "SELECT test_id, unit, round(abs_corr, 6) AS abs_corr, rank FROM x_corr_ranked WHERE rank <= 10")
def t02(spark, sf):
    return rounded(structural.top_donors(structural.donor_correlations(aligned_series(panel(spark, sf, "weekly"))), 10))


@check("t02_selected_covariates", """
SELECT test_id, unit, round(abs_corr, 6) AS abs_corr, rank FROM x_corr_ranked WHERE CASE WHEN good > 0 THEN abs_corr > 0.3 AND rank <= 10 ELSE rank <= 3 END
""")
def t02b(spark, sf):
    return rounded(structural.select_covariates(structural.donor_correlations(aligned_series(panel(spark, sf, "weekly")))))


RESULT_SQL = """test_id, method, round(absolute_lift, 1) AS absolute_lift, round(relative_lift, 5) AS relative_lift, round(lift_lower_ci, 5) AS lift_lower_ci,
 round(lift_upper_ci, 5) AS lift_upper_ci, round(se, 1) AS se, round(p_value, 5) AS p_value, is_significant, round(cohen_d, 5) AS cohen_d,
 round(lift_likelihood, 5) AS lift_likelihood, round(l2_imbalance, 5) AS l2_imbalance, round(r_squared, 5) AS r_squared"""


@check("c09_structural", f"SELECT {RESULT_SQL} FROM x_bsr")
def c09(spark, sf):
    return rounded(structural.structural_results(structural.structural_series(aligned_series(panel(spark, sf, "weekly")))), 5, absolute_lift=1, se=1)


@check("c10_estimators", f"SELECT {RESULT_SQL} FROM x_estimates")
def c10(spark, sf):
    return rounded(analysis.estimator_results(panel(spark, sf, "weekly")), 5, absolute_lift=1, se=1)


@check("c13_halves_test", """
SELECT test_id, CASE WHEN a.test_id IS NOT NULL THEN 'ascm' WHEN d.test_id IS NOT NULL THEN 'did' ELSE 'skipped' END AS method,
       round(coalesce(a.p_value, d.p_value, 1), 6) AS p_value, coalesce(a.p_value, d.p_value, 1) > 0.05 AS is_passed
FROM x_tests LEFT JOIN (SELECT * FROM x_scr_h WHERE target = '*treatment*') a USING (test_id) LEFT JOIN x_did_h d USING (test_id)
""")
def c13(spark, sf):
    return rounded(analysis.halves_test(panel(spark, sf, "weekly"), tests_table(spark)))


@check("c15_placebo_in_space", """
SELECT test_id, 'in_space' AS placebo_type, target, round(relative_lift, 6) AS estimated_effect, round(p_value, 6) AS p_value, is_significant AS is_false_positive
FROM x_scr_w WHERE target <> '*treatment*'
""")
def c15(spark, sf):
    return rounded(analysis.placebo_in_space(synth.ascm_series(series(spark, sf))))


@check("c24_test_reports")
def c24(spark, sf):
    stores = daily(spark, sf)
    market = market_daily(spark, sf).select("date", "geo", F.col("revenue").alias("marketplace"))
    both = stores.join(market, ["date", "geo"], "left").withColumn("store", F.col("revenue")).fillna(0.0, ["marketplace"])
    out = analysis.analyse_tests(both, tests_table(spark), assignment(spark, sf), spend_daily(spark, sf), PD.edges(spark, sf), platforms=("store", "marketplace"))
    return out.select(*[c for c in out.columns if c != "platform_lifts"], *[F.col("platform_lifts")[m][x].alias(f"{m}_{x}") for m in ("store", "marketplace") for x in ("absolute_lift", "relative_lift", "p_value")])


@check("d12_auto_design")
def d12(spark, sf):
    return design.auto_design(
        PD.pre_panel(spark, sf).select("test_id", "geo", "date", "revenue"), per_test(spark, PD.matching(spark, sf)), PD.edges(spark, sf), "2001-08-01")[0]


# ---- budget by running sum ------------------------------------------------------------------


@check("w12_running_allocation", """
SELECT channel, CAST(j AS INTEGER) AS j, round(spent, 4) AS spent FROM (
  SELECT channel, j, sum(step) OVER (ORDER BY gain DESC, channel, j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM (
    SELECT channel, j, 100.0 AS step, scale * (pow((j + 1) * 100.0, 0.5) - pow(j * 100.0, 0.5)) AS gain FROM (SELECT channel, sum(spend) / 1000 AS scale FROM x_spend GROUP BY 1), range(91) g(j))) WHERE spent <= 9050
""")
def w12(spark, sf):
    s = spend_daily(spark, sf).groupBy("channel").agg((F.sum("spend") / 1000).alias("scale"))
    j = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(90))))
    gain = F.col("scale") * (F.pow((F.col("j") + 1) * 100.0, F.lit(0.5)) - F.pow(F.col("j") * 100.0, F.lit(0.5)))
    inc = j.select(F.lit("all").alias("scenario"), "channel", "j", F.lit(100.0).alias("step"), gain.alias("gain"))
    return rounded(budget.take_increments(inc, 9050.0).select("channel", "j", "spent"), 4)
