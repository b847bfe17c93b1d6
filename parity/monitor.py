"""Gates, alerts, rankings, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.functions import scalars as S
from liftfield.operators import gates as G
from liftfield.operators import latest as L
from liftfield.operators import media as MM
from liftfield.operators import monitor as M
from parity import media as PM
from parity.common import assignment, check, h, market_daily, market_lines, rounded, table, view
from parity.staging import good_events

# ---- window measures ------------------------------------------------------------------------

view("x_mroi", """
SELECT channel, week, v, lag(v) OVER (PARTITION BY channel ORDER BY week) AS p FROM (
  SELECT channel, CAST(date_trunc('week', date) AS DATE) AS week, sum(k) / sum(spend) AS v FROM x_events GROUP BY 1, 2)
""")


def _drops_sql(src: str, key: str, limit: float, ok: str) -> str:
    return f"""SELECT {key}week, round(v, 6) AS value, round(p, 6) AS previous, round(CASE WHEN {ok} THEN (p - v) / abs(p) * 100 END, 4) AS drop_pct,
    coalesce(CASE WHEN {ok} THEN (p - v) / abs(p) * 100 END > {limit}, false) AS is_alert FROM {src}"""


def mroi(spark, sf):
    from parity.common import spend_events

    w = spend_events(spark, sf).groupBy("channel", F.date_trunc("week", "date").cast("date").alias("week")).agg((F.sum("k") / F.sum("spend")).alias("value"))
    return M.weekly_drops(w, ["channel"], "value", 3.0)


@check("w08_mroi_drop", _drops_sql("x_mroi", "channel, ", 3.0, "p <> 0"))
def w08(spark, sf):
    return rounded(mroi(spark, sf).drop("threshold"), 6, drop_pct=4)


view("x_wrev", """
SELECT week, v, lag(v) OVER (ORDER BY week) AS p FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS week, sum(revenue) AS v FROM x_market GROUP BY 1)
""")


def revenue_drops(spark, sf):
    w = market_lines(spark, sf).groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(F.sum("revenue").alias("value"))
    return M.weekly_drops(w.withColumn("scope", F.lit("marketplace")), ["scope"], "value", 15.0, positive_only=True).drop("scope")


@check("w08_revenue_drop", _drops_sql("x_wrev", "", 15.0, "p > 0").replace("round(v, 6)", "round(v, 4)").replace("round(p, 6)", "round(p, 4)"))
def w08b(spark, sf):
    return rounded(revenue_drops(spark, sf).drop("threshold"), 4)


view("x_decay", """
SELECT channel, date, beta_mean, avg(beta_mean) OVER (PARTITION BY channel ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS m FROM x_betas
""")


def decay(spark, sf):
    return M.beta_decay(PM.betas(spark, sf), 5.0)


@check("w09_beta_decay", """
SELECT channel, date, round(beta_mean, 5) AS beta_mean, round(m, 5) AS trailing_mean, round((m - beta_mean) / abs(m) * 100, 4) AS drop_pct,
       (m - beta_mean) / abs(m) * 100 > 5 AS is_alert FROM x_decay WHERE m <> 0
""")
def w09(spark, sf):
    return rounded(decay(spark, sf).drop("beta_p10", "beta_p90", "threshold"), 5, drop_pct=4)


# predicted = the market's value on its previous day with data
view("x_pred", """
SELECT geo, date, revenue AS actual, lag(revenue) OVER (PARTITION BY geo ORDER BY date) AS predicted FROM x_market_daily
""")
view("x_err", "SELECT * FROM x_pred WHERE predicted IS NOT NULL")


def errors(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("geo").orderBy("date")
    return market_daily(spark, sf).select("geo", "date", F.col("revenue").alias("actual"), F.lag("revenue").over(w).alias("predicted")).filter("predicted IS NOT NULL")


view("x_roll", """
SELECT date, sum(s) OVER w / sum(n) OVER w AS mape FROM (SELECT date, sum(abs(actual - predicted) / (abs(actual) + 1e-8)) AS s, count(*) AS n FROM x_err GROUP BY 1)
WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)
""")


@check("w14_rolling_mape", "SELECT date, round(mape, 6) AS mape, mape > 1.5 AS needs_refit FROM x_roll")
def w14(spark, sf):
    return rounded(M.rolling_error(errors(spark, sf), 1.5).drop("threshold"))


for _key, _cols in (("a20_mape_by_market", ["geo"]), ("a20_mape_national", ["scope"])):
    _sel = "geo" if _cols == ["geo"] else "'all' AS scope"

    def _fn(spark, sf, cols=_cols):
        return rounded(M.mape(errors(spark, sf).withColumn("scope", F.lit("all")), cols))

    check(_key, f"SELECT {_sel}, round(avg(abs(actual - predicted) / (abs(actual) + 1e-8)), 6) AS mape FROM x_err GROUP BY ALL")(_fn)


view("x_georoi", """
SELECT channel, geo, round(sum(k) / sum(spend), 1) AS marginal_roi, sum(spend) AS spend FROM x_events GROUP BY 1, 2
""")


def geo_roi(spark, sf):
    from parity.common import spend_events

    return spend_events(spark, sf).groupBy("channel", "geo").agg(F.round(F.sum("k") / F.sum("spend"), 1).alias("marginal_roi"), F.sum("spend").alias("spend"))


view("x_georank", """
SELECT channel, geo, marginal_roi, CAST(floor(rank() OVER (PARTITION BY channel ORDER BY marginal_roi DESC) + (count(*) OVER (PARTITION BY channel, marginal_roi) - 1) / 2) AS BIGINT) AS rank FROM x_georoi
""")


@check("w10_average_rank", "SELECT channel, geo, marginal_roi, rank FROM x_georank")
def w10(spark, sf):
    return M.average_rank(geo_roi(spark, sf).drop("spend"), "marginal_roi", ["channel"])


for _key, _bottom in (("t01_top_markets", False), ("t01_bottom_markets", True)):
    def _fn(spark, sf, bottom=_bottom):
        ranked = M.average_rank(geo_roi(spark, sf).drop("spend"), "marginal_roi", ["channel"])
        return M.top_ranked(ranked, 20, bottom)

    _dir = "rank DESC, geo DESC" if _bottom else "rank, geo"
    check(_key, f"SELECT channel, geo, marginal_roi, rank FROM x_georank ORDER BY {_dir} LIMIT 20")(_fn)


# ---- saturation by market -------------------------------------------------------------------

view("x_geosat", """
SELECT channel, geo, spend, inflection, spend / inflection AS ratio, CASE WHEN spend / inflection < 0.6 THEN 'Under-Invested' WHEN spend / inflection < 1.3 THEN 'Optimal' ELSE 'Saturated' END AS status
FROM x_georoi JOIN (SELECT channel, avg(spend) * 0.9 AS inflection FROM x_georoi GROUP BY 1) USING (channel)
""")


def geo_saturation(spark, sf):
    g = geo_roi(spark, sf).drop("marginal_roi")
    return M.saturation_table(g, g.groupBy("channel").agg((F.avg("spend") * 0.9).alias("gamma")))


@check("m23_saturation_table", """
SELECT channel, geo, round(spend, 2) AS spend, round(inflection, 4) AS inflection, round(ratio, 6) AS ratio, status, round(inflection - spend, 4) AS recommended_change FROM x_geosat
""")
def m23(spark, sf):
    return rounded(geo_saturation(spark, sf), 4, spend=2, ratio=6)


@check("a25_status_shares", "SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM x_geosat GROUP BY 1")
def a25(spark, sf):
    return rounded(M.status_shares(geo_saturation(spark, sf), "status"))


@check("f12_bands", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v >= 3 THEN 'Excellent' WHEN v >= 1 THEN 'Profitable' WHEN v >= 0 THEN 'Below Breakeven' ELSE 'Negative' END AS iroas_label,
       CASE WHEN q >= 80 THEN 'Trustworthy' WHEN q >= 60 THEN 'Marginal' ELSE 'Not Trustworthy' END AS trust_label,
       CASE WHEN 1 + v / 50 < 1.05 THEN 'OK' WHEN 1 + v / 50 < 1.10 THEN 'Warning' ELSE 'Bad' END AS rhat_status
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10 - 1 AS v, l_quantity * 2 AS q FROM lineitem)
""")
def f12(spark, sf):
    v, q = F.col("l_quantity") / 10 - 1, F.col("l_quantity") * 2
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        S.banded(v, [(0, "Negative"), (1, "Below Breakeven"), (3, "Profitable")], "Excellent").alias("iroas_label"),
        S.banded(q, [(60, "Not Trustworthy"), (80, "Marginal")], "Trustworthy").alias("trust_label"),
        S.banded(1 + v / 50, [(1.05, "OK"), (1.10, "Warning")], "Bad").alias("rhat_status"))


# ---- decomposition --------------------------------------------------------------------------

view("x_base", "SELECT 'shopify' AS outcome, sum(revenue) / 1000 AS value FROM x_daily UNION ALL SELECT 'amazon', sum(revenue) / 1000 FROM x_market_daily")
view("x_decomp", """
SELECT outcome, 0 AS position, 'baseline' AS label, value, value * 0.92 AS low80, value * 1.08 AS high80, value * 0.88 AS low95, value * 1.12 AS high95 FROM x_base
UNION ALL SELECT outcome, 1, channel, cm, c10, c90, c10, c90 FROM x_chres UNION ALL SELECT outcome, 2, 'residual', 0, 0, 0, 0, 0 FROM x_base
""")


def decomposition(spark, sf):
    from parity.common import daily

    total = lambda df, o: df.agg(F.lit(o).alias("outcome"), (F.sum("revenue") / 1000).alias("value"))
    base = total(daily(spark, sf), "shopify").unionByName(total(market_daily(spark, sf), "amazon"))
    return M.decomposition(PM.results(spark, sf), base)


@check("m22_decomposition", """
SELECT outcome, position, label, round(value, 4) AS value, round(low80, 4) AS low80, round(high80, 4) AS high80, round(low95, 4) AS low95, round(high95, 4) AS high95 FROM x_decomp
""")
def m22(spark, sf):
    return rounded(decomposition(spark, sf), 4)


@check("w13_waterfall", """
SELECT outcome, position, label, round(value, 4) AS value, round(sum(value) OVER (PARTITION BY outcome ORDER BY position, label), 4) AS cumulative FROM x_decomp
UNION ALL SELECT outcome, 3, 'total', round(sum(value), 4), round(sum(value), 4) FROM x_decomp GROUP BY 1
""")
def w13(spark, sf):
    return rounded(M.waterfall(decomposition(spark, sf).select("outcome", "position", "label", "value"), ["outcome"]), 4)


view("x_mta", "SELECT channel, sum(attributed_revenue) AS value FROM x_attr GROUP BY 1")
view("x_mmm", "SELECT CASE channel WHEN 'click' THEN 'meta_performance' ELSE channel END AS channel, sum(cm) * 10000 AS value FROM x_chres GROUP BY 1")
view("x_gap", """
SELECT channel, mta, mmm, (mmm - mta) / greatest(abs(mta), abs(mmm), 1) AS delta FROM (
  SELECT channel, coalesce(a.value, 0) AS mta, coalesce(b.value, 0) AS mmm FROM x_mta a FULL JOIN x_mmm b USING (channel))
""")


def gaps(spark, sf):
    mta = PM.attribution(spark, sf).groupBy("channel").agg(F.sum("attributed_revenue").alias("value"))
    name = F.when(F.col("channel") == "click", "meta_performance").otherwise(F.col("channel"))
    mmm = PM.results(spark, sf).groupBy(name.alias("channel")).agg((F.sum("contribution_mean") * 10000).alias("value"))
    return M.attribution_gap(mta, mmm)


@check("j13_attribution_gap", "SELECT channel, round(mta, 2) AS mta, round(mmm, 4) AS mmm, round(delta, 6) AS delta, abs(delta) > 0.4 AS is_large FROM x_gap")
def j13(spark, sf):
    return rounded(gaps(spark, sf).drop("threshold"), 6, mta=2, mmm=4)


@check("u04_channel_union", "SELECT channel, mta <> 0 AS in_attribution, mmm <> 0 AS in_model FROM x_gap")
def u04(spark, sf):
    return gaps(spark, sf).select("channel", (F.col("mta") != 0).alias("in_attribution"), (F.col("mmm") != 0).alias("in_model"))


@check("j12_model_vs_test", """
SELECT channel, round(roi_mean, 6) AS roi_mean, iroas AS test_iroas, round(CASE WHEN iroas <> 0 AND roi_mean > 0 THEN (roi_mean - iroas) / iroas END, 6) AS delta
FROM x_chres LEFT JOIN x_measured USING (channel) WHERE outcome = 'shopify'
""")
def j12(spark, sf):
    return rounded(M.model_vs_test(PM.results(spark, sf), PM.measured(spark, sf)))


@check("a21_contribution_ratio", """
SELECT outcome, round(c / r, 6) AS ratio, abs(c / r - 1) <= 0.05 AS is_within FROM (SELECT outcome, sum(value) AS c FROM x_decomp GROUP BY 1) JOIN (SELECT outcome, value AS r FROM x_base) USING (outcome)
""")
def a21(spark, sf):
    d = decomposition(spark, sf)
    base = d.filter("label = 'baseline'").select("outcome", F.col("value").alias("revenue"))
    return rounded(M.contribution_ratio(d.select("outcome", F.col("value").alias("contribution")), base, ["outcome"]))


@check("a22_rhat_summary", """
SELECT round(max(rhat), 6) AS rhat_max, round(avg(rhat), 6) AS rhat_mean, count(*) FILTER (rhat > 1.05) AS n_high, arg_max(parameter, rhat) AS worst_parameter FROM x_rhat
""")
def a22(spark, sf):
    return rounded(M.rhat_summary(PM.rhats(spark, sf)))


@check("a23_beta_cv", "SELECT channel, round(stddev_pop(beta_mean) / abs(avg(beta_mean)), 6) AS cv FROM x_betas GROUP BY 1")
def a23(spark, sf):
    return rounded(M.beta_cv(PM.betas(spark, sf)))


# ---- runs -----------------------------------------------------------------------------------

view("x_runs", """
SELECT 'run_' || (o_custkey % 20) AS run_id, max(o_orderdate)::DATE AS saved, avg(o_totalprice) AS mape_store, max(o_totalprice) AS rhat_max, CAST(count(*) AS DOUBLE) AS n_days,
       CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 1.0 ELSE 0.0 END AS converged FROM orders GROUP BY 1
""")


def runs(spark, sf):
    return table(spark, sf, "orders").groupBy(F.concat(F.lit("run_"), (F.col("o_custkey") % 20).cast("string")).alias("run_id")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("saved"), F.avg("o_totalprice").alias("mape_store"), F.max("o_totalprice").alias("rhat_max"),
        F.count("*").alias("n_days"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("converged"))


view("x_metrics", " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, {m} AS value FROM x_runs" for m in ("mape_store", "rhat_max", "n_days", "converged")))


@check("m21_metric_rows", "SELECT run_id, metric, round(value, 4) AS value FROM x_metrics")
def m21(spark, sf):
    return rounded(M.metric_rows(runs(spark, sf).drop("saved"), "run_id"), 4)


@check("m20_run_comparison", """
SELECT metric, round(a, 4) AS value_a, round(b, 4) AS value_b, round(b - a, 4) AS delta, round(CASE WHEN abs(a) > 0.000000001 THEN (b - a) / abs(a) * 100 END, 4) AS delta_pct,
       CASE WHEN metric LIKE '%mape%' OR metric LIKE '%rhat%' THEN b - a < 0 ELSE b - a > 0 END AS is_improved
FROM (SELECT metric, max(value) FILTER (run_id = 'run_3') AS a, max(value) FILTER (run_id = 'run_7') AS b FROM x_metrics GROUP BY 1)
""")
def m20(spark, sf):
    return rounded(M.compare_runs(M.metric_rows(runs(spark, sf).drop("saved"), "run_id"), "run_3", "run_7"), 4)


@check("t08_last_runs", "SELECT run_id, saved, n_days::BIGINT AS n_days FROM x_runs ORDER BY saved DESC, run_id DESC LIMIT 10")
def t08(spark, sf):
    return L.newest(runs(spark, sf).select("run_id", "saved", "n_days"), ["saved", "run_id"], 10)


# ---- calibration ----------------------------------------------------------------------------


@check("w07_latest_event", """
SELECT channel, ingested_seq, test_end_date FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY test_end_date DESC, ingested_seq DESC) AS rk FROM x_cal_ok) WHERE rk = 1
""")
def w07(spark, sf):
    return M.latest_calibration(good_events(spark, sf)).select("channel", "ingested_seq", "test_end_date")


@check("m24_calibration_staleness", """
SELECT channel, max(test_end_date) AS last_end, count(*) AS n_events, CAST(DATE '2001-12-31' - max(test_end_date) AS INTEGER) AS age_days,
       CASE WHEN DATE '2001-12-31' - max(test_end_date) > 160 THEN 'stale' ELSE 'current' END AS status FROM x_cal_ok GROUP BY 1
""")
def m24(spark, sf):
    return M.calibration_staleness(good_events(spark, sf), "2001-12-31", 160)


@check("m25_model_constraints", """
SELECT channel, outcome, lift_abs, round(lift_lower_90, 2) AS lift_lower, round(lift_upper_90, 2) AS lift_upper, spend_in_period, CAST(test_start_date AS VARCHAR) AS start_date,
       CAST(test_end_date AS VARCHAR) AS end_date, round(roi, 4) AS implied_roi, test_type FROM x_cal_ok
""")
def m25(spark, sf):
    return rounded(M.model_constraints(good_events(spark, sf)), 4, lift_lower=2, lift_upper=2)


# ---- exclusion plans ------------------------------------------------------------------------

# ad sets = parts, already excluded markets = nations of the suppliers of their lines
view("x_adsets", """
SELECT test_id, adset_id, geo FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS adset_id, CAST(s_nationkey AS VARCHAR) AS geo
  FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey), (SELECT test_id FROM x_tests)
""")
view("x_allsets", "SELECT DISTINCT test_id, CAST(p_partkey AS VARCHAR) AS adset_id FROM part, x_tests")
view("x_managed", "SELECT test_id, adset_id FROM x_allsets WHERE adset_id LIKE '%1'")
view("x_plan", """
SELECT s.test_id, s.adset_id, a.geo FROM x_allsets s JOIN x_assign a ON a.test_id = s.test_id AND a.cell = 'holdout'
WHERE NOT EXISTS (SELECT 1 FROM x_adsets e WHERE e.test_id = s.test_id AND e.adset_id = s.adset_id AND e.geo = a.geo)
""")


def adsets(spark, sf):
    from parity.common import per_test

    p, li, s = table(spark, sf, "part"), table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    adset = F.col("p_partkey").cast("string").alias("adset_id")
    used = p.join(li, F.col("p_partkey") == F.col("l_partkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    lists = used.groupBy(adset).agg(F.collect_set(F.col("s_nationkey").cast("string")).alias("excluded"))
    every = p.select(adset).distinct().join(lists, "adset_id", "left")
    return per_test(spark, every.withColumn("excluded", F.coalesce("excluded", F.array().cast("array<string>"))))


@check("j14_exclusion_plan", "SELECT * FROM x_plan")
def j14(spark, sf):
    return M.exclusion_plan(adsets(spark, sf), assignment(spark, sf))


@check("j14_exclusion_update", "SELECT * FROM x_plan WHERE adset_id NOT LIKE '%1'")
def j14b(spark, sf):
    a = adsets(spark, sf)
    return M.exclusion_plan(a, assignment(spark, sf), a.filter("adset_id LIKE '%1'"))


@check("j15_revert_plan", """
SELECT s.test_id, s.adset_id, 1 AS taken_at, coalesce(string_agg(e.geo, ',' ORDER BY e.geo), '') AS excluded FROM (SELECT DISTINCT test_id, adset_id FROM x_plan) s
LEFT JOIN x_adsets e ON e.test_id = s.test_id AND e.adset_id = s.adset_id GROUP BY 1, 2
""")
def j15(spark, sf):
    a = adsets(spark, sf)
    first = M.targeting_snapshots(a, M.exclusion_plan(a, assignment(spark, sf))).withColumn("taken_at", F.lit(1))
    later = first.withColumn("taken_at", F.lit(2)).withColumn("excluded", F.array(F.lit("changed")))
    plan = M.revert_plan(first.unionByName(later))
    return plan.select("test_id", "adset_id", "taken_at", F.array_join(F.sort_array("excluded"), ",").alias("excluded"))


@check("j16_designs_with_report", """
SELECT 'test_' || c_custkey AS test_id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_report FROM customer
""")
def j16(spark, sf):
    name = lambda c: F.concat(F.lit("test_"), F.col(c).cast("string")).alias("test_id")
    designs = table(spark, sf, "customer").select(name("c_custkey"))
    return M.with_report_flag(designs, table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(name("o_custkey")))


# ---- gates ----------------------------------------------------------------------------------

# one row of gate facts per customer, spread around every threshold
view("x_gfacts", """
SELECT c_custkey AS run, 0.02 * (c_custkey % 11) AS mape_shopify, 0.03 * (c_custkey % 9) AS mape_amazon, 0.9 + 0.02 * (c_custkey % 10) AS ratio_shopify, 0.9 + 0.025 * (c_custkey % 8) AS ratio_amazon,
       1.0 + 0.02 * (c_custkey % 7) AS rhat_max, 0.05 * (c_custkey % 12) AS lift_gap, c_custkey % 5 <> 0 AS is_monotone, 0.1 * (c_custkey % 6) AS beta_first, 0.25 AS beta_second,
       0.1 * (c_custkey % 8) + 0.03 AS gap_max, c_custkey % 4 <> 0 AS beta_plausible FROM customer
""")


def gate_facts(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("run"), (0.02 * (k % 11)).alias("mape_shopify"), (0.03 * (k % 9)).alias("mape_amazon"), (0.9 + 0.02 * (k % 10)).alias("ratio_shopify"),
        (0.9 + 0.025 * (k % 8)).alias("ratio_amazon"), (1.0 + 0.02 * (k % 7)).alias("rhat_max"), (0.05 * (k % 12)).alias("lift_gap"), (k % 5 != 0).alias("is_monotone"),
        (0.1 * (k % 6)).alias("beta_first"), F.lit(0.25).alias("beta_second"), (0.1 * (k % 8) + 0.03).alias("gap_max"), (k % 4 != 0).alias("beta_plausible"))


view("x_gates", """
SELECT *, mape_shopify < 0.10 AS ms, mape_amazon < 0.15 AS ma, ratio_shopify BETWEEN 0.95 AND 1.05 AS rs, ratio_amazon BETWEEN 0.93 AND 1.07 AS ra, rhat_max < 1.05 AS cv, lift_gap < 0.25 AS lf, beta_first > beta_second AS bo FROM x_gfacts
""")


@check("m14_gate_fit", """
SELECT run, concat_ws(',', CASE WHEN NOT ms THEN 'mape_shopify' END, CASE WHEN NOT ma THEN 'mape_amazon' END, CASE WHEN NOT rs THEN 'ratio_shopify' END, CASE WHEN NOT cv THEN 'convergence' END) AS blockers,
       CASE WHEN NOT ra THEN 'ratio_amazon' ELSE '' END AS warnings, ms AND ma AND rs AND cv AS gate1_passed FROM x_gates
""")
def m14(spark, sf):
    g = G.gate_fit(gate_facts(spark, sf))
    return g.select("run", F.array_join("gate1_blockers", ",").alias("blockers"), F.array_join("gate1_warnings", ",").alias("warnings"), "gate1_passed")


@check("m15_gate_causal", """
SELECT run, lf AS gate2_passed, concat_ws(',', CASE WHEN NOT is_monotone THEN 'monotone' END, CASE WHEN NOT bo THEN 'beta_order' END) AS warnings FROM x_gates
""")
def m15(spark, sf):
    g = G.gate_causal(gate_facts(spark, sf))
    return g.select("run", "gate2_passed", F.array_join("gate2_warnings", ",").alias("warnings"))


@check("m15_lift_reconciliation", """
SELECT round(avg(abs(m - lift_abs) / abs(lift_abs)), 6) AS lift_gap, count(*) AS n_events FROM (
  SELECT e.event_id, any_value(e.lift_abs) AS lift_abs, sum(c.c) AS m FROM (
    SELECT user_id * 1000 + event_id % 1000 AS event_id, channel, 'shopify' AS outcome, date AS a, date + CAST(k % 5 AS INTEGER) AS b, spend * 30 + 1 AS lift_abs FROM x_events) e
  JOIN (SELECT channel, outcome, date, sum(contribution_mean) AS c FROM x_contrib GROUP BY 1, 2, 3) c ON c.channel = e.channel AND c.outcome = e.outcome AND c.date BETWEEN e.a AND e.b GROUP BY 1)
""".replace("user_id * 1000 + event_id % 1000", "event_id").replace("event_id AS event_id", "event_id"))
def m15b(spark, sf):
    from parity.common import spend_events

    e = spend_events(spark, sf).select(
        "event_id", "channel", F.lit("shopify").alias("outcome"), (F.col("spend") * 30 + 1).alias("lift_abs"), F.col("date").alias("test_start_date"),
        F.date_add("date", (F.col("k") % 5).cast("int")).alias("test_end_date"))
    return rounded(G.lift_reconciliation(e, PM.contributions(spark, sf)))


@check("m15_monotone_curves", """
SELECT channel, outcome, coalesce(min(d), 0) >= -0.000000001 AS is_monotone FROM (SELECT channel, outcome, rev - lag(rev) OVER (PARTITION BY channel, outcome ORDER BY s) AS d FROM (
  SELECT *, CASE WHEN channel = 'view' AND i = 50 THEN 0 ELSE i END AS rev, i AS s FROM x_params, range(100) g(i))) GROUP BY 1, 2
""")
def m15c(spark, sf):
    c = MM.saturation_curves(PM.curve_params(spark, sf))
    return G.curves_monotone(c.withColumn("revenue", F.when((F.col("channel") == "view") & (F.col("point") == 50), 0.0).otherwise(F.col("revenue"))))


@check("m16_gate_attribution", """
SELECT round(gap_max, 6) AS gap_max, n_large_gaps, round(cv_max, 6) AS cv_max, cv_max < 0.5 AS beta_plausible FROM
 (SELECT max(abs(delta)) AS gap_max, count(*) FILTER (abs(delta) > 0.4) AS n_large_gaps FROM x_gap), (SELECT max(cv) AS cv_max FROM (SELECT channel, stddev_pop(beta_mean) / abs(avg(beta_mean)) AS cv FROM x_betas GROUP BY 1))
""")
def m16(spark, sf):
    return rounded(G.gate_attribution(gaps(spark, sf), M.beta_cv(PM.betas(spark, sf))))


@check("m17_gate_score", """
SELECT run, CAST(score AS DOUBLE) AS trust_score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Marginal' ELSE 'Insufficient' END AS trust_label, p AS all_passed
FROM (SELECT run, ms AND ma AND rs AND cv AND lf AS p, CASE WHEN ms THEN 15 WHEN mape_shopify < 0.10 * 1.5 THEN 7 ELSE 0 END + CASE WHEN ma THEN 10 WHEN mape_amazon < 0.15 * 1.5 THEN 5 ELSE 0 END
  + CASE WHEN cv THEN 20 WHEN rhat_max < 1.1 THEN 10 ELSE 0 END + CASE WHEN rs AND ra THEN 5 WHEN rs OR ra THEN 2 ELSE 0 END + CASE WHEN lf THEN 25 WHEN lift_gap < 0.25 * 1.5 THEN 12 ELSE 0 END
  + CASE WHEN is_monotone THEN 10 ELSE 0 END + CASE WHEN bo THEN 5 ELSE 0 END + CASE WHEN gap_max < 0.4 THEN 5 WHEN gap_max < 0.6 THEN 2 ELSE 0 END + CASE WHEN beta_plausible THEN 5 ELSE 0 END AS score FROM x_gates)
""")
def m17(spark, sf):
    g = G.gate_score(G.gate_causal(G.gate_fit(gate_facts(spark, sf))))
    return g.select("run", "trust_score", "trust_label", "all_passed")


@check("m19_production_gates", """
SELECT run, concat_ws(',', CASE WHEN mape_shopify > 0.15 THEN 'national_mape' END, CASE WHEN mape_amazon > 0.25 THEN 'geo_mape' END, CASE WHEN NOT gap_max BETWEEN 0.3 AND 0.7 THEN 'paid_share' END,
         CASE WHEN rhat_max >= 1.05 THEN 'rhat' END, CASE WHEN run % 1000 < 400 THEN 'ess' END, CASE WHEN run % 60 > 50 THEN 'divergences' END) AS failures,
       concat_ws(',', CASE WHEN beta_first * 10 > 3 THEN 'ci_ratio' END, CASE WHEN NOT lift_gap BETWEEN 0.3 AND 0.6 THEN 'baseline_share' END) AS warnings FROM x_gfacts
""")
def m19(spark, sf):
    f = gate_facts(spark, sf).select(
        "run", F.col("mape_shopify").alias("national_mape"), F.col("mape_amazon").alias("geo_median_mape"), F.col("gap_max").alias("paid_share"),
        "rhat_max", (F.col("run") % 1000).alias("min_ess"), (F.col("run") % 60).alias("n_divergences"), (F.col("beta_first") * 10).alias("ci_ratio"),
        F.col("lift_gap").alias("baseline_share"))
    g = G.production_gates(f)
    return g.select("run", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"))


# ---- panel placebos -------------------------------------------------------------------------

view("x_pp", "SELECT 'store' AS test_id, date, geo, coalesce(store, 0) AS value FROM x_kpi UNION ALL SELECT 'marketplace', date, geo, coalesce(marketplace, 0) FROM x_kpi")
view("x_ppd", """
SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY test_id) AS n FROM (SELECT test_id, date, avg(value) AS v FROM x_pp GROUP BY 1, 2)
""")


def placebo_panel(spark, sf):
    k = PM.kpi(spark, sf)
    cols = F.array(*[F.struct(F.lit(n).alias("test_id"), F.coalesce(n, F.lit(0.0)).alias("value")) for n in ("store", "marketplace")])
    return k.select("date", "geo", F.explode(cols).alias("c")).select("c.test_id", "date", "geo", "c.value")


view("x_ppi", "SELECT test_id, CAST(idx >= n // 2 AS INTEGER) AS half, idx - CASE WHEN idx >= n // 2 THEN n // 2 ELSE 0 END AS i, v FROM x_ppd")
view("x_ppb", f"""
SELECT test_id, rep, (avg(v) FILTER (half = 1) - avg(v) FILTER (half = 0)) / abs(avg(v) FILTER (half = 0)) AS e FROM (
  SELECT d.test_id, d.rep, d.half, i.v FROM (SELECT p.test_id, p.half, b.rep, {h('p.test_id', 'b.rep', 'p.half', 'p.i')} % (count(*) OVER (PARTITION BY p.test_id, p.half, b.rep)) AS pick FROM x_ppi p, range(500) b(rep)) d
  JOIN x_ppi i ON i.test_id = d.test_id AND i.half = d.half AND i.i = d.pick) GROUP BY 1, 2
""")
view("x_pph", """
SELECT test_id, effect, ci_low, ci_high, p_value, abs(effect) < 0.1 AS is_passed FROM (SELECT test_id, (avg(v) FILTER (half = 1) - avg(v) FILTER (half = 0)) / abs(avg(v) FILTER (half = 0)) AS effect FROM x_ppi GROUP BY 1)
JOIN (SELECT test_id, quantile_cont(e, 0.05) AS ci_low, quantile_cont(e, 0.95) AS ci_high, 2 * least(avg(CASE WHEN e >= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN e <= 0 THEN 1.0 ELSE 0.0 END)) AS p_value FROM x_ppb GROUP BY 1) USING (test_id)
""")


@check("m18_placebo_halves", "SELECT test_id, round(effect, 6) AS effect, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value, is_passed FROM x_pph")
def m18(spark, sf):
    return rounded(G.placebo_halves(placebo_panel(spark, sf)))


view("x_pps", """
SELECT test_id, CAST(s.i AS INTEGER) AS split, (avg(v) FILTER (idx >= floor(n * f) AND idx < floor(n * f) + greatest(n // 4, 2)) - avg(v) FILTER (idx < floor(n * f))) / abs(avg(v) FILTER (idx < floor(n * f))) AS effect
FROM x_ppd, (VALUES (0, 0.2), (1, 0.2 + (0.65 - 0.2) * 1 / 2), (2, 0.2 + (0.65 - 0.2) * 2 / 2)) s(i, f) GROUP BY 1, 2
""")


@check("m18_placebo_splits", "SELECT test_id, split, round(effect, 6) AS effect, abs(effect) < 0.1 * 1.5 AS is_passed FROM x_pps")
def m18b(spark, sf):
    return rounded(G.placebo_splits(placebo_panel(spark, sf)))


view("x_ppm", """
SELECT test_id, geo, ((avg(value) FILTER (hf = 1) - avg(other) FILTER (hf = 1)) - (avg(value) FILTER (hf = 0) - avg(other) FILTER (hf = 0))) / greatest(abs(avg(value) FILTER (hf = 0)), 1) AS effect
FROM (SELECT p.*, CASE WHEN d.idx >= d.n // 2 THEN 1 ELSE 0 END AS hf, (sum(value) OVER (PARTITION BY p.test_id, p.date) - value) / (count(*) OVER (PARTITION BY p.test_id, p.date) - 1) AS other
      FROM x_pp p JOIN x_ppd d ON d.test_id = p.test_id AND d.date = p.date)
WHERE geo IN (SELECT geo FROM (SELECT geo, row_number() OVER (ORDER BY geo) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT geo FROM x_pp)) WHERE i >= floor(g * 0.75)) GROUP BY 1, 2
""")


@check("m18_placebo_markets", "SELECT test_id, geo, round(effect, 6) AS effect, abs(effect) < 0.2 AS is_passed FROM x_ppm")
def m18c(spark, sf):
    return rounded(G.placebo_markets(placebo_panel(spark, sf)))


@check("m18_placebo_report", """
SELECT test_id, hp AS halves_passed, round(sr, 6) AS split_rate, round(mr, 6) AS market_rate, CAST(CASE WHEN hp THEN 5 ELSE 0 END + CASE WHEN sr >= 0.8 THEN 5 ELSE 0 END + CASE WHEN mr >= 0.8 THEN 5 ELSE 0 END AS INTEGER) AS bonus,
       hp AND sr >= 0.8 AND mr >= 0.8 AS is_passed
FROM (SELECT test_id, is_passed AS hp FROM x_pph) JOIN (SELECT test_id, avg(CASE WHEN abs(effect) < 0.15 THEN 1.0 ELSE 0.0 END) AS sr FROM x_pps GROUP BY 1) USING (test_id)
JOIN (SELECT test_id, avg(CASE WHEN abs(effect) < 0.2 THEN 1.0 ELSE 0.0 END) AS mr FROM x_ppm GROUP BY 1) USING (test_id)
""")
def m18d(spark, sf):
    p = placebo_panel(spark, sf)
    return rounded(G.placebo_report(G.placebo_halves(p), G.placebo_splits(p), G.placebo_markets(p)))


# ---- alerts ---------------------------------------------------------------------------------


@check("m26_alert_table", """
SELECT 'mroi_drop' AS rule, 'high' AS severity, channel AS subject, week AS at, round((p - v) / abs(p) * 100, 4) AS value, 3.0 AS threshold FROM x_mroi WHERE p <> 0 AND (p - v) / abs(p) * 100 > 3
UNION ALL SELECT 'revenue_drop', 'high', 'marketplace', week, round((p - v) / abs(p) * 100, 4), 15.0 FROM x_wrev WHERE p > 0 AND (p - v) / p * 100 > 15
UNION ALL SELECT 'beta_decay', 'medium', channel, date, round((m - beta_mean) / abs(m) * 100, 4), 5.0 FROM x_decay WHERE m <> 0 AND (m - beta_mean) / abs(m) * 100 > 5
UNION ALL SELECT 'high_error', 'high', 'model', date, round(mape * 100, 4), 150.0 FROM x_roll WHERE mape > 1.5
UNION ALL SELECT 'attribution_gap', 'high', channel, NULL, round(abs(delta) * 100, 4), 40.0 FROM x_gap WHERE abs(delta) > 0.4
UNION ALL SELECT 'no_convergence', 'critical', parameter, NULL, round(rhat, 4), 1.05 FROM x_rhat WHERE rhat > 1.05
UNION ALL SELECT 'failed_load', 'critical', 'load_' || o_orderpriority, CAST(max(o_orderdate) AS DATE), NULL, 0.0 FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'new_calibration', 'info', channel, test_end_date, round(roi, 4), 0.0 FROM x_cal_ok WHERE test_end_date >= DATE '2001-07-25'
""")
def m26(spark, sf):
    failures = table(spark, sf, "orders").groupBy(F.concat(F.lit("load_"), F.col("o_orderpriority")).alias("task")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("at"))
    new = good_events(spark, sf).filter("test_end_date >= DATE'2001-07-25'")
    a = M.alert_table(mroi(spark, sf), revenue_drops(spark, sf), decay(spark, sf), M.rolling_error(errors(spark, sf), 1.5), gaps(spark, sf),
                      PM.rhats(spark, sf), failures, new)
    return rounded(a, 4)
