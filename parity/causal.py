"""Difference-in-differences, replication inference, ensemble, returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.operators import causal as C
from liftfield.operators import panel as P
from liftfield.operators import quality as Q
from liftfield.operators import returns as R
from liftfield.operators import validation as V
from parity import synthetic  # noqa: F401  (registers the CTEs of the other two estimators)
from parity.common import (
    assignment, check, h, market_daily, panel, per_test, phi, r, rounded, spend_daily, student_p, tests_table, view,
)

Z975 = C.normal_quantile(0.975)


def did_views(tag: str, src: str, keys: str, value: str = "revenue", n_boot: int = 2000) -> None:
    """CTEs x_ch_<tag> (market changes), x_eff_<tag>, x_boot_<tag> (replicates) and x_did_<tag> (results)."""
    view(f"x_ch_{tag}", f"""
    SELECT *, post_mean - pre_mean AS diff FROM (SELECT {keys}, geo, cell, avg({value}) FILTER (period = 'pre') AS pre_mean,
           avg({value}) FILTER (period = 'post') AS post_mean FROM {src} GROUP BY {keys}, geo, cell)""")
    f = lambda fn, col, cell: f"{fn}({col}) FILTER (cell = '{cell}')"
    view(f"x_eff_{tag}", f"""
    SELECT {keys}, {f('avg', 'diff', 'treatment')} - {f('avg', 'diff', 'holdout')} AS tau,
      {f('avg', 'pre_mean', 'treatment')} + {f('avg', 'post_mean', 'holdout')} - {f('avg', 'pre_mean', 'holdout')} AS proj,
      {f('avg', 'post_mean', 'holdout')} AS post_h, {f('var_samp', 'diff', 'treatment')} AS vt, {f('var_samp', 'diff', 'holdout')} AS vh,
      {f('count', 'diff', 'treatment')} AS nt, {f('count', 'diff', 'holdout')} AS nh FROM x_ch_{tag} GROUP BY {keys}
    HAVING {f('count', 'diff', 'treatment')} > 0 AND {f('count', 'diff', 'holdout')} > 0""")
    on = " AND ".join(f"i.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    ik = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    view(f"x_idx_{tag}", f"""
    SELECT {keys}, cell, diff, row_number() OVER (PARTITION BY {keys}, cell ORDER BY geo) - 1 AS idx,
           count(*) OVER (PARTITION BY {keys}, cell) AS n FROM x_ch_{tag} WHERE diff IS NOT NULL""")
    view(f"x_draw_{tag}", f"""
    SELECT {ik}, d.cell, b.rep, {h(*[f'd.{k.strip()}' for k in keys.split(',')], 'b.rep', 'd.cell', 'd.idx')} % d.n AS pick FROM x_idx_{tag} d, range({n_boot}) b(rep)""")
    view(f"x_boot_{tag}", f"""
    SELECT {ik}, d.rep, avg(i.diff) FILTER (i.cell = 'treatment') - avg(i.diff) FILTER (i.cell = 'holdout') AS tau
    FROM x_draw_{tag} d JOIN x_idx_{tag} i ON {on} AND i.cell = d.cell AND i.idx = d.pick GROUP BY {ik}, d.rep""")
    view(f"x_did_{tag}", f"""
    SELECT {keys}, 'did' AS method, tau AS absolute_lift, base AS baseline, se, CASE WHEN base > 0 THEN tau / base ELSE 0 END AS relative_lift,
      CASE WHEN base > 0 THEN (tau - {Z975!r} * se) / base ELSE 0 END AS lift_lower_ci,
      CASE WHEN base > 0 THEN (tau + {Z975!r} * se) / base ELSE 0 END AS lift_upper_ci,
      CASE WHEN se > 0 THEN 2.0 * (1.0 - {phi('abs(tau / se)')}) ELSE 1 END AS p_value,
      CASE WHEN sqrt((vt + vh) / 2) > 0 THEN tau / sqrt((vt + vh) / 2) ELSE 0 END AS cohen_d,
      CASE WHEN se > 0 THEN {phi('tau / se')} ELSE 0.5 END AS lift_likelihood, nt AS n_treatment, nh AS n_holdout
    FROM (SELECT *, CASE WHEN proj > 0 THEN proj ELSE post_h END AS base FROM x_eff_{tag})
    JOIN (SELECT {keys}, stddev_pop(tau) AS se FROM x_boot_{tag} GROUP BY {keys}) USING ({keys})""")


did_views("w", "x_wpanel", "test_id")
did_views("d", "x_panel", "test_id")
did_views("win", "x_winsor", "test_id")
ROUNDS = dict(absolute_lift=3, baseline=3, se=3)
DID_SQL = """round(absolute_lift, 3) AS absolute_lift, round(baseline, 3) AS baseline, round(se, 3) AS se, round(relative_lift, 6) AS relative_lift,
 round(lift_lower_ci, 6) AS lift_lower_ci, round(lift_upper_ci, 6) AS lift_upper_ci, round(p_value, 6) AS p_value, p_value < 0.05 AS is_significant,
 round(cohen_d, 6) AS cohen_d, round(lift_likelihood, 6) AS lift_likelihood, n_treatment, n_holdout"""


@check("c01_did", f"SELECT test_id, method, {DID_SQL} FROM x_did_w")
def c01(spark, sf):
    did = C.difference_in_differences(panel(spark, sf, "weekly"))
    return rounded(did.drop("l2_imbalance", "r_squared"), 6, **ROUNDS)


@check("c02_bootstrap", """
SELECT test_id, count(*) AS n, round(avg(tau), 3) AS mean_tau, round(stddev_pop(tau), 3) AS se, round(min(tau), 3) AS low, round(max(tau), 3) AS high
FROM x_boot_w GROUP BY 1
""")
def c02(spark, sf):
    b = C.bootstrap_effects(C.geo_changes(panel(spark, sf, "weekly")))
    return rounded(b.groupBy("test_id").agg(
        F.count("*").alias("n"), F.avg("tau").alias("mean_tau"), F.stddev_pop("tau").alias("se"), F.min("tau").alias("low"), F.max("tau").alias("high")), 3)


# gap series: treatment mean minus the plain donor mean
view("x_gaps", """
SELECT test_id, period, date, max(y) FILTER (unit = '*treatment*') - avg(y) FILTER (unit <> '*treatment*') AS gap FROM x_aligned GROUP BY 1, 2, 3
""")


def gaps(spark, sf):
    s = P.aligned_series(panel(spark, sf, "weekly"))
    treated = F.col("unit") == P.TREATED_UNIT
    return s.groupBy("test_id", "period", "date").agg(
        (F.max(F.when(treated, F.col("y"))) - F.avg(F.when(~treated, F.col("y")))).alias("gap"))


view("x_gap_idx", """
SELECT test_id, gap - avg(gap) OVER (PARTITION BY test_id) AS g, row_number() OVER (PARTITION BY test_id ORDER BY date) - 1 AS idx,
       count(*) OVER (PARTITION BY test_id) AS n FROM x_gaps WHERE period = 'post'
""")


@check("c03_bootstrap_p", f"""
SELECT test_id, round(any_value(o.observed), 3) AS observed, round(greatest(avg(CASE WHEN abs(m.m) >= abs(o.observed) THEN 1.0 ELSE 0.0 END), 1.0 / 2001.0), 6) AS p_value
FROM (SELECT d.test_id, d.rep, avg(i.g) AS m FROM (
        SELECT i.test_id, b.rep, {h('i.test_id', 'b.rep', 'i.idx')} % i.n AS pick FROM x_gap_idx i, range(2000) b(rep)) d
      JOIN x_gap_idx i ON i.test_id = d.test_id AND i.idx = d.pick GROUP BY 1, 2) m
JOIN (SELECT test_id, avg(gap) AS observed FROM x_gaps WHERE period = 'post' GROUP BY 1) o USING (test_id) GROUP BY test_id
""")
def c03(spark, sf):
    return rounded(C.bootstrap_p(gaps(spark, sf).filter("period = 'post'")), 6, observed=3)


view("x_tstat_w", """
SELECT test_id, CASE WHEN nt >= 2 AND nh >= 2 THEN tau / sqrt(((nt - 1) * vt + (nh - 1) * vh) / (nt + nh - 2) * (1.0 / nt + 1.0 / nh)) END AS t_stat,
       CASE WHEN nt >= 2 AND nh >= 2 THEN nt + nh - 2 END AS dof FROM x_eff_w
""")


@check("c04_quick_t", "SELECT test_id, round(t_stat, 6) AS t_stat, dof FROM x_tstat_w")
def c04(spark, sf):
    return rounded(C.pooled_t(C.geo_changes(panel(spark, sf, "weekly"))))


@check("c04_quick_p", f"SELECT test_id, round(t_stat, 6) AS t_stat, dof, round(coalesce({student_p('t_stat', 'dof')}, 1), 6) AS p_value FROM x_tstat_w")
def c04b(spark, sf):
    return rounded(C.quick_did_p(C.geo_changes(panel(spark, sf, "weekly"))))


view("x_perm", f"""
SELECT test_id, rep, observed, avg(gap) AS stat FROM (
  SELECT g.test_id, b.rep, g.gap, row_number() OVER (PARTITION BY g.test_id, b.rep ORDER BY {h('g.test_id', 'b.rep', 'g.date')}, g.date) AS rk, n_post, observed
  FROM x_gaps g, range(2000) b(rep), (SELECT test_id, count(*) AS n_post, avg(gap) AS observed FROM x_gaps WHERE period = 'post' GROUP BY 1) o
  WHERE o.test_id = g.test_id) WHERE rk <= n_post GROUP BY 1, 2, 3
""")


@check("c07_conformal", """
SELECT test_id, round(effect, 3) AS effect, round(p_value, 6) AS p_value, round(se, 3) AS se, round(least(a, b), 3) AS ci_lower, round(greatest(a, b), 3) AS ci_upper
FROM (SELECT test_id, any_value(observed) AS effect, (count(*) FILTER (abs(stat) >= abs(observed)) + 1) / 2001.0 AS p_value, stddev_pop(stat) AS se,
             any_value(observed) - (quantile_cont(stat, 0.975) - avg(stat)) AS a, any_value(observed) - (quantile_cont(stat, 0.025) - avg(stat)) AS b
      FROM x_perm GROUP BY 1)
""")
def c07(spark, sf):
    return rounded(C.conformal_inference(gaps(spark, sf)), 3, p_value=6)


# ---- placebos -------------------------------------------------------------------------------

view("x_wsplits", """
SELECT test_id, CAST(s.i AS INTEGER) AS split, date AS split_date FROM (
  SELECT test_id, date, row_number() OVER (PARTITION BY test_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY test_id) AS n
  FROM (SELECT DISTINCT test_id, date FROM x_wpanel WHERE period = 'pre')), range(5) s(i)
WHERE n >= 21 AND idx = floor(floor(n * 0.3) + (floor(n * 0.7) - floor(n * 0.3)) * (s.i / 4) + 0.000000001)
""")
view("x_relabelled", """
SELECT p.test_id, s.split, p.geo, p.cell, p.date, p.revenue, CASE WHEN p.date < s.split_date THEN 'pre' ELSE 'post' END AS period
FROM x_wpanel p JOIN x_wsplits s ON s.test_id = p.test_id WHERE p.period = 'pre'
""")
did_views("pl", "x_relabelled", "test_id, split")


def placebos(spark, sf):
    return V.placebo_in_time(panel(spark, sf, "weekly"))


@check("c14_placebo_in_time", """
SELECT test_id, 'in_time' AS placebo_type, split, split_date, round(relative_lift, 6) AS estimated_effect, round(p_value, 6) AS p_value,
       p_value < 0.05 AS is_false_positive FROM x_did_pl JOIN x_wsplits USING (test_id, split)
""")
def c14(spark, sf):
    return rounded(placebos(spark, sf))


@check("c16_false_positive_rate", """
SELECT test_id, n AS n_placebos, round(fpr, 6) AS false_positive_rate, round(1 - fpr, 6) AS pass_rate,
       CASE WHEN fpr > 0.15 THEN 'blocker' WHEN fpr > 0.10 THEN 'warning' ELSE 'ok' END AS fpr_level
FROM (SELECT t.test_id, count(p.test_id) AS n, coalesce(avg(CASE WHEN p.p_value < 0.05 THEN 1.0 ELSE 0.0 END) FILTER (p.test_id IS NOT NULL), 0) AS fpr
      FROM x_tests t LEFT JOIN x_did_pl p USING (test_id) GROUP BY 1)
""")
def c16(spark, sf):
    return rounded(V.placebo_summary(placebos(spark, sf), tests_table(spark)))


@check("q10_winsor_comparison", """
SELECT test_id, round(raw_lift, 6) AS raw_lift, round(raw_p, 6) AS raw_p, round(w_lift, 6) AS winsorised_lift, round(w_p, 6) AS winsorised_p,
       round(d, 6) AS divergence, d > 0.3 AS is_outlier_driven, (raw_p < 0.05) <> (w_p < 0.05) AS significance_flips,
       CASE WHEN d > 0.3 AND (raw_p < 0.05) <> (w_p < 0.05) THEN 'investigate' WHEN d > 0.3 THEN 'moderate' ELSE 'robust' END AS advice
FROM (SELECT *, CASE WHEN (abs(raw_lift) + abs(w_lift)) / 2 > 0.001 THEN abs(raw_lift - w_lift) / ((abs(raw_lift) + abs(w_lift)) / 2) ELSE 0 END AS d
      FROM (SELECT a.test_id, a.relative_lift AS raw_lift, a.p_value AS raw_p, b.relative_lift AS w_lift, b.p_value AS w_p
            FROM x_did_w a JOIN x_did_win b USING (test_id)))
""")
def q10(spark, sf):
    p = panel(spark, sf, "weekly")
    return rounded(Q.compare_winsorised(
        C.difference_in_differences(p), C.difference_in_differences(Q.winsorise(p, low=0.1, high=0.9))))


# ---- ensemble of the three estimators ---------------------------------------------------------

view("x_wmetrics", """
SELECT test_id, geo, cell, date, period, 'revenue' AS metric, revenue AS value FROM x_wpanel
UNION ALL SELECT test_id, geo, cell, date, period, 'orders', orders FROM x_wpanel
UNION ALL SELECT test_id, geo, cell, date, period, 'revenue_per_order', revenue / orders FROM x_wpanel
""")
did_views("m", "x_wmetrics", "test_id, metric", "value")
view("x_weighted", """
SELECT *, raw / sum(raw) OVER (PARTITION BY test_id) AS weight FROM (
  SELECT *, CASE method WHEN 'ascm' THEN 2.0 WHEN 'bsts' THEN 1.5 ELSE 0.5 END * (0.5 * greatest(0, 1 - l2_imbalance * 10) + 0.5 * greatest(0, r_squared) + 0.1) AS raw
  FROM x_estimates)
""")


def metric_panel(spark, sf):
    p = panel(spark, sf, "weekly").select(
        "test_id", "geo", "cell", "date", "period", "revenue", "orders", (F.col("revenue") / F.col("orders")).alias("revenue_per_order"))
    return R.unpivot_metrics(p, ["revenue", "orders", "revenue_per_order"])


def results(spark, sf):
    from liftfield.plans.analysis import estimator_results

    return estimator_results(panel(spark, sf, "weekly"))


@check("c11_ensemble_weights", "SELECT test_id, method, round(weight, 5) AS weight FROM x_weighted")
def c11(spark, sf):
    return rounded(C.ensemble_weights(results(spark, sf)).select("test_id", "method", "weight"), 5)


view("x_ensemble", """
SELECT test_id, sum(absolute_lift * weight) AS absolute_lift, sum(relative_lift * weight) AS relative_lift, min(lift_lower_ci) AS lift_lower_ci,
       max(lift_upper_ci) AS lift_upper_ci, max(p_value) AS p_value, bool_and(is_significant) AS is_significant, sum(cohen_d * weight) AS cohen_d,
       sum(lift_likelihood * weight) AS lift_likelihood, arg_max(l2_imbalance, weight) AS l2_imbalance, arg_max(r_squared, weight) AS r_squared,
       count(*) AS n_methods FROM x_weighted GROUP BY 1
""")


@check("c12_ensemble", """
SELECT test_id, 'ensemble' AS method, round(absolute_lift, 1) AS absolute_lift, round(relative_lift, 5) AS relative_lift, round(lift_lower_ci, 5) AS lift_lower_ci,
       round(lift_upper_ci, 5) AS lift_upper_ci, round(p_value, 5) AS p_value, is_significant, round(cohen_d, 5) AS cohen_d,
       round(lift_likelihood, 5) AS lift_likelihood, round(l2_imbalance, 5) AS l2_imbalance, round(r_squared, 5) AS r_squared, n_methods FROM x_ensemble
""")
def c12(spark, sf):
    return rounded(C.weighted_ensemble(results(spark, sf)), 5, absolute_lift=1)


view("x_agreement", """
SELECT test_id, 0.4 * CASE WHEN up + down > 0 THEN greatest(up, down) / n ELSE 1 END
  + 0.3 * CASE WHEN abs(m) > 0.001 THEN greatest(0, 1 - s / abs(m)) WHEN s < 0.01 THEN 1 ELSE 0.5 END
  + 0.3 * CASE WHEN kinds = 1 THEN 1 ELSE 0.5 END AS agreement
FROM (SELECT test_id, count(*) AS n, count(*) FILTER (relative_lift > 0.000001) AS up, count(*) FILTER (relative_lift < -0.000001) AS down,
             avg(relative_lift) AS m, stddev_pop(relative_lift) AS s, count(DISTINCT is_significant) AS kinds FROM x_estimates GROUP BY 1)
""")


@check("c17_agreement", "SELECT test_id, round(agreement, 5) AS agreement FROM x_agreement")
def c17(spark, sf):
    return rounded(V.estimator_agreement(results(spark, sf)), 5)


view("x_facts", """
SELECT test_id, e.p_value > 0.05 AS aa_passed, coalesce(f.fpr, 0) AS fpr, agreement, l2_imbalance AS l2, r_squared AS r2 FROM x_ensemble e JOIN x_agreement USING (test_id)
LEFT JOIN (SELECT test_id, avg(CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.0 END) AS fpr FROM x_did_pl GROUP BY 1) f USING (test_id)
""")


@check("c18_trust_score", """
SELECT test_id, blockers, round(score, 4) AS trust_score, blockers = '' AND score >= 70 AS is_trustworthy,
       concat_ws(',', CASE WHEN fpr > 0.10 AND fpr <= 0.15 THEN 'false_positives' END, CASE WHEN agreement >= 0.5 AND agreement < 0.7 THEN 'disagreement' END,
         CASE WHEN l2 > 0.05 AND l2 <= 0.10 THEN 'pre_fit' END, CASE WHEN r2 < 0.90 THEN 'r_squared' END, CASE WHEN blockers = '' AND score < 70 THEN 'trust_score' END) AS warnings
FROM (SELECT *, least(100, greatest(0, CASE WHEN aa_passed THEN 25 ELSE 0 END + CASE WHEN fpr <= 0.06 THEN 20 WHEN fpr <= 0.10 THEN 15 WHEN fpr <= 0.15 THEN 8 ELSE 0 END
        + 20 * agreement + greatest(0, 1 - l2 / 0.10) * 10 + greatest(0, (r2 - 0.80) / 0.10) * 10 + CASE WHEN blockers = '' THEN 15 ELSE 0 END)) AS score
      FROM (SELECT *, concat_ws(',', CASE WHEN NOT aa_passed THEN 'aa_test' END, CASE WHEN fpr > 0.15 THEN 'false_positives' END,
              CASE WHEN agreement < 0.5 THEN 'disagreement' END, CASE WHEN l2 > 0.10 THEN 'pre_fit' END) AS blockers FROM x_facts))
""")
def c18(spark, sf):
    res = results(spark, sf)
    e = C.weighted_ensemble(res).select(
        "test_id", (F.col("p_value") > 0.05).alias("aa_passed"), F.col("l2_imbalance").alias("l2"), F.col("r_squared").alias("r2"))
    fpr = V.placebo_summary(placebos(spark, sf), tests_table(spark)).select("test_id", F.col("false_positive_rate").alias("fpr"))
    t = V.trust_score(e.join(V.estimator_agreement(res), "test_id").join(fpr, "test_id"))
    return t.select("test_id", F.array_join("blockers", ",").alias("blockers"), r(F.col("trust_score"), 4).alias("trust_score"),
                    "is_trustworthy", F.array_join("warnings", ",").alias("warnings"))


# ---- returns --------------------------------------------------------------------------------

view("x_totals", """
SELECT test_id, cell, sum(revenue) AS total, avg(revenue) AS avg_per_geo_day, count(DISTINCT geo) AS n_geos, count(DISTINCT date) AS n_days
FROM x_panel WHERE period = 'post' GROUP BY 1, 2
""")


@check("a16_cell_totals", "SELECT test_id, cell, round(total, 2) AS total, round(avg_per_geo_day, 3) AS avg_per_geo_day, n_geos, n_days FROM x_totals")
def a16(spark, sf):
    return rounded(R.cell_totals(panel(spark, sf)), 3, total=2)


view("x_scale", """
SELECT t.test_id, count(*) FILTER (cell = 'treatment') AS n_treatment, CAST(any_value(end_date) - any_value(start_date) + 1 AS BIGINT) AS n_days
FROM x_tests t JOIN x_assign USING (test_id) GROUP BY 1
""")


@check("a16_organic_baseline", """
SELECT s.test_id, round(t.total, 2) AS treatment_revenue, round(o.total, 2) AS holdout_revenue, n_treatment, s.n_days,
       round(o.avg_per_geo_day * n_treatment * s.n_days, 2) AS organic_baseline
FROM x_scale s JOIN x_totals t ON t.test_id = s.test_id AND t.cell = 'treatment' JOIN x_totals o ON o.test_id = s.test_id AND o.cell = 'holdout'
""")
def a16b(spark, sf):
    return rounded(R.organic_baseline(R.cell_totals(panel(spark, sf)), tests_table(spark), assignment(spark, sf)), 2)


def scale(spark, sf):
    size = assignment(spark, sf).groupBy("test_id").agg(F.count_if(F.col("cell") == "treatment").alias("n_treatment"))
    days = (F.datediff("end_date", "start_date") + 1).cast("bigint").alias("n_days")
    return size.join(tests_table(spark).select("test_id", days), "test_id")


view("x_increment", """
SELECT test_id, total AS incremental_revenue, CASE WHEN base > 0 THEN lift_lower_ci * base ELSE total END AS incremental_lower,
       CASE WHEN base > 0 THEN lift_upper_ci * base ELSE total END AS incremental_upper
FROM (SELECT d.*, absolute_lift * s.n_treatment * n_days AS total,
        CASE WHEN abs(relative_lift) > 0.000001 THEN absolute_lift / relative_lift ELSE 0 END * s.n_treatment * n_days AS base FROM x_did_d d JOIN x_scale s USING (test_id))
""")


def increment(spark, sf):
    return R.incremental_revenue(C.difference_in_differences(panel(spark, sf)), scale(spark, sf))


@check("c19_incremental_revenue", """
SELECT test_id, round(incremental_revenue, 1) AS incremental_revenue, round(incremental_lower, 1) AS incremental_lower, round(incremental_upper, 1) AS incremental_upper FROM x_increment
""")
def c19(spark, sf):
    return rounded(increment(spark, sf), 1)


view("x_tspend", """
SELECT t.test_id, coalesce(sum(spend), 0.0) AS spend FROM x_tests t LEFT JOIN (
  SELECT a.test_id, s.date, s.spend FROM x_spend s JOIN x_assign a ON a.geo = s.geo AND a.cell = 'treatment') s
  ON s.test_id = t.test_id AND s.date BETWEEN start_date AND end_date GROUP BY 1
""")


def tspend(spark, sf):
    return R.treatment_spend(spend_daily(spark, sf), tests_table(spark), assignment(spark, sf))


view("x_iroas", """
SELECT test_id, CASE WHEN spend > 0 THEN incremental_revenue ELSE 0 END AS incremental_revenue, spend AS total_spend,
       CASE WHEN spend > 0 THEN incremental_revenue / spend ELSE 0 END AS iroas, CASE WHEN spend > 0 THEN incremental_lower / spend ELSE 0 END AS iroas_lower,
       CASE WHEN spend > 0 THEN incremental_upper / spend ELSE 0 END AS iroas_upper FROM x_increment JOIN x_tspend USING (test_id)
""")


@check("c20_iroas", """
SELECT test_id, round(incremental_revenue, 1) AS incremental_revenue, round(total_spend, 2) AS total_spend, round(iroas, 4) AS iroas,
       round(iroas_lower, 4) AS iroas_lower, round(iroas_upper, 4) AS iroas_upper FROM x_iroas
""")
def c20(spark, sf):
    return rounded(R.iroas(increment(spark, sf), tspend(spark, sf)), 4, incremental_revenue=1, total_spend=2)


@check("c21_incremental_order_ratio", """
SELECT test_id, round(inc, 4) AS incremental_orders, round(CASE WHEN inc > 0 AND attributed > 0 THEN inc / attributed ELSE 0 END, 6) AS incremental_order_ratio,
       round(CASE WHEN inc > 0 THEN spend / inc ELSE 0 END, 6) AS cpia
FROM (SELECT test_id, spend, CASE WHEN spend > 0 THEN greatest((t - h) * n_treatment * n_days, 0) ELSE 0 END AS inc,
             (SELECT count(*) FROM events WHERE event_type = 'purchase') AS attributed
      FROM (SELECT test_id, avg(m) FILTER (cell = 'treatment') AS t, avg(m) FILTER (cell = 'holdout') AS h FROM (
              SELECT test_id, cell, geo, avg(orders) AS m FROM x_panel WHERE period = 'post' GROUP BY 1, 2, 3) GROUP BY 1)
      JOIN x_scale USING (test_id) JOIN x_tspend USING (test_id))
""")
def c21(spark, sf):
    from parity.common import table

    bought = table(spark, sf, "events").filter("event_type = 'purchase'").agg(F.count("*").cast("double").alias("attributed"))
    attributed = per_test(spark, bought)
    return rounded(R.incremental_order_ratio(panel(spark, sf), scale(spark, sf), tspend(spark, sf), attributed), 6, incremental_orders=4)


@check("c22_metric_breakdown", f"SELECT test_id, metric, {DID_SQL} FROM x_did_m")
def c22(spark, sf):
    did = C.difference_in_differences(metric_panel(spark, sf), ["test_id", "metric"], "value")
    return rounded(did.drop("l2_imbalance", "r_squared", "method"), 6, **ROUNDS)


view("x_platforms", """
SELECT test_id, geo, cell, date, period, 'store' AS metric, revenue AS value FROM x_wpanel
UNION ALL SELECT w.test_id, w.geo, w.cell, w.date, w.period, 'marketplace', coalesce(m.revenue, 0) FROM x_wpanel w LEFT JOIN (
  SELECT CAST(date_trunc('week', date) AS DATE) AS date, geo, sum(revenue) AS revenue FROM x_market_daily GROUP BY 1, 2) m USING (date, geo)
""")
did_views("pf", "x_platforms", "test_id, metric", "value")


def platform_panel(spark, sf):
    """Weekly store panel with the marketplace's revenue of the same market and week beside it."""
    m = market_daily(spark, sf).groupBy(F.date_trunc("week", "date").cast("date").alias("date"), "geo").agg(F.sum("revenue").alias("marketplace"))
    p = panel(spark, sf, "weekly").join(m, ["date", "geo"], "left")
    return p.select("test_id", "geo", "cell", "date", "period", F.col("revenue").alias("store"), F.coalesce("marketplace", F.lit(0.0)).alias("marketplace"))


def platforms(spark, sf):
    return C.difference_in_differences(R.unpivot_metrics(platform_panel(spark, sf), ["store", "marketplace"]), ["test_id", "metric"], "value")


@check("c22_platform_breakdown", f"SELECT test_id, metric, {DID_SQL} FROM x_did_pf")
def c22b(spark, sf):
    return rounded(platforms(spark, sf).drop("l2_imbalance", "r_squared", "method"), 6, **ROUNDS)


@check("c25_recommendations", """
SELECT test_id, CAST(pos - 1 AS INTEGER) AS position, code FROM (
  SELECT test_id, row_number() OVER (PARTITION BY test_id ORDER BY ord) AS pos, code FROM (
    SELECT test_id, 1 AS ord, CASE WHEN is_significant THEN 'significant_lift' ELSE 'not_significant' END AS code FROM x_ensemble
    UNION ALL SELECT test_id, 2, CASE WHEN iroas >= 3 THEN 'iroas_excellent' WHEN iroas >= 1 THEN 'iroas_profitable' WHEN iroas > 0 THEN 'iroas_below_breakeven' ELSE 'iroas_negative' END FROM x_iroas
    UNION ALL SELECT test_id, 3, CASE WHEN p_value < 0.05 THEN 'halo_significant' ELSE 'halo_possible' END FROM x_did_pf WHERE metric = 'marketplace' AND relative_lift > 0))
""")
def c25(spark, sf):
    """The ensemble's verdict, the return and the lift of the marketplace in the same markets."""
    main = C.weighted_ensemble(results(spark, sf)).select("test_id", "is_significant")
    money = R.iroas(increment(spark, sf), tspend(spark, sf)).select("test_id", "iroas")
    return R.recommendations(main.join(R.halo(platforms(spark, sf)), "test_id").join(money, "test_id"))
