"""Market history, matching, power and spillover."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.functions import scalars as S
from liftfield.functions.stats import normal_cdf, normal_quantile
from liftfield.operators import assign as A
from liftfield.operators import design as D
from liftfield.operators import power as P
from liftfield.operators import spillover as X
from parity.common import (
    N_HOLDOUT, assignment, check, daily, geos, h, market_daily, panel, per_test, phi, population, r, rounded, spend_daily, student_p, table, view,
)

Z2 = normal_quantile(0.975)
ZSUM = normal_quantile(0.975) + normal_quantile(0.80)

# ---- history --------------------------------------------------------------------------------

view("x_alldays", """
SELECT geo, date, sum(revenue) AS y FROM (SELECT geo, date, revenue FROM x_daily UNION ALL SELECT geo, date, revenue FROM x_market_daily) GROUP BY 1, 2
""")
view("x_geoweeks", """
SELECT s.geo, s.week, coalesce(w.y, 0) AS y FROM (
  SELECT geo, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week FROM (
    SELECT geo, min(date_trunc('week', date)) AS a, max(date_trunc('week', date)) AS b FROM x_alldays GROUP BY 1 HAVING count(*) >= 7) WHERE b > a) s
LEFT JOIN (SELECT geo, CAST(date_trunc('week', date) AS DATE) AS week, sum(y) AS y FROM x_alldays GROUP BY 1, 2) w USING (geo, week)
""")
view("x_trend", """
SELECT geo, coalesce(avg(change), 0) AS revenue_trend, CASE WHEN avg(y) > 0 THEN stddev_samp(y) / avg(y) ELSE 0 END AS revenue_volatility
FROM (SELECT geo, y, y / nullif(lag(y) OVER (PARTITION BY geo ORDER BY week), 0) - 1 AS change FROM x_geoweeks) GROUP BY 1
""")
view("x_history", """
SELECT geo, coalesce(s.r, 0) AS store_revenue, CAST(coalesce(s.o, 0) AS BIGINT) AS store_orders, coalesce(m.r, 0) AS marketplace_revenue,
       CAST(coalesce(m.o, 0) AS BIGINT) AS marketplace_orders, coalesce(e.c, 0) AS click_spend, coalesce(e.v, 0) AS view_spend, coalesce(e.x, 0) AS other_spend,
       coalesce(revenue_trend, 0) AS revenue_trend, coalesce(revenue_volatility, 0) AS revenue_volatility
FROM (SELECT geo, sum(revenue) AS r, sum(orders) AS o FROM x_daily GROUP BY 1) s
FULL JOIN (SELECT geo, sum(revenue) AS r, sum(orders) AS o FROM x_market_daily GROUP BY 1) m USING (geo)
FULL JOIN (SELECT geo, sum(spend) FILTER (channel = 'click') AS c, sum(spend) FILTER (channel = 'view') AS v, sum(spend) FILTER (channel NOT IN ('click', 'view')) AS x FROM x_spend GROUP BY 1) e USING (geo)
LEFT JOIN x_trend USING (geo)
""")
view("x_matching", """
SELECT h.*, store_revenue + marketplace_revenue AS total_revenue, store_orders + marketplace_orders AS total_orders, click_spend + view_spend + other_spend AS total_ad_spend,
       coalesce(population, 1) AS population, (store_revenue + marketplace_revenue) / coalesce(population, 1) AS revenue_per_capita
FROM x_history h LEFT JOIN x_population USING (geo)
""")


def history(spark, sf):
    s = spend_daily(spark, sf)
    return D.market_history(
        {"store": daily(spark, sf), "marketplace": market_daily(spark, sf)},
        {"click": s.filter("channel = 'click'"), "view": s.filter("channel = 'view'"), "other": s.filter("channel NOT IN ('click', 'view')")})


def matching(spark, sf):
    return D.matching_table(history(spark, sf), population(spark, sf))


@check("a09_market_history", """
SELECT geo, round(store_revenue, 2) AS store_revenue, store_orders, round(marketplace_revenue, 4) AS marketplace_revenue, marketplace_orders,
       round(click_spend, 2) AS click_spend, round(view_spend, 2) AS view_spend, round(other_spend, 2) AS other_spend, round(total_revenue, 4) AS total_revenue, total_orders,
       round(total_ad_spend, 2) AS total_ad_spend, round(CASE WHEN total_orders > 0 THEN total_revenue / total_orders ELSE 0 END, 4) AS aov FROM x_matching
""")
def a09(spark, sf):
    return rounded(history(spark, sf).drop("revenue_trend", "revenue_volatility"), 4, store_revenue=2, click_spend=2, view_spend=2, other_spend=2, total_ad_spend=2)


@check("a10_weekly_trend", "SELECT geo, round(revenue_trend, 6) AS revenue_trend, round(revenue_volatility, 6) AS revenue_volatility FROM x_trend")
def a10(spark, sf):
    cols = ["geo", "date", "revenue"]
    return rounded(D.weekly_trend(daily(spark, sf).select(cols).unionByName(market_daily(spark, sf).select(cols))))


@check("a11_matching_table", """
SELECT geo, population, round(total_revenue, 4) AS total_revenue, round(revenue_per_capita, 4) AS revenue_per_capita FROM x_matching
""")
def a11(spark, sf):
    return rounded(matching(spark, sf).select("geo", "population", "total_revenue", "revenue_per_capita"), 4)


# ---- variance and power ---------------------------------------------------------------------

view("x_pre", "SELECT * FROM x_panel WHERE period = 'pre'")
view("x_vweeks", "SELECT test_id, geo, strftime(date, '%Y-%W') AS week, sum(revenue) AS y FROM x_pre GROUP BY 1, 2, 3")
view("x_rho_geo", """
SELECT test_id, geo, covar_pop(y, b) / (stddev_pop(y) FILTER (b IS NOT NULL) * stddev_pop(b)) AS rho
FROM (SELECT test_id, geo, y, lag(y) OVER (PARTITION BY test_id, geo ORDER BY week) AS b FROM x_vweeks) GROUP BY 1, 2
HAVING count(*) >= 4 AND stddev_pop(y) FILTER (b IS NOT NULL) > 0 AND stddev_pop(b) > 0
""")
view("x_var", """
SELECT test_id, between_var, within_var, between_var + within_var AS total_var, mean_daily, mean_weekly,
       sqrt(between_var + within_var) / mean_weekly AS cv, n_geos, n_periods, coalesce(rho, 0) AS rho
FROM (SELECT test_id, avg(v) AS within_var, greatest(0, var_samp(m) - avg(v) / greatest(avg(n), 1)) AS between_var, avg(m) AS mean_weekly, count(*) AS n_geos
      FROM (SELECT test_id, geo, var_samp(y) AS v, avg(y) AS m, count(*) AS n FROM x_vweeks GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT test_id, count(DISTINCT week) AS n_periods FROM x_vweeks GROUP BY 1) USING (test_id)
JOIN (SELECT test_id, avg(m) AS mean_daily FROM (SELECT test_id, geo, avg(revenue) AS m FROM x_pre GROUP BY 1, 2) GROUP BY 1) USING (test_id)
LEFT JOIN (SELECT test_id, avg(rho) AS rho FROM x_rho_geo GROUP BY 1) USING (test_id)
""")


def pre_panel(spark, sf):
    return panel(spark, sf).filter("period = 'pre'")


def variance(spark, sf):
    return P.variance_components(pre_panel(spark, sf))


def sized_variance(spark, sf):
    return variance(spark, sf).withColumn("n_holdout", F.lit(N_HOLDOUT)).withColumn("n_treatment", F.col("n_geos") - N_HOLDOUT)


@check("a12_variance_components", """
SELECT test_id, round(between_var, 0) AS between_var, round(within_var, 0) AS within_var, round(total_var, 0) AS total_var, round(mean_daily, 3) AS mean_daily,
       round(mean_weekly, 3) AS mean_weekly, round(cv, 6) AS cv, n_geos, n_periods, round(rho, 6) AS rho FROM x_var
""")
def a12(spark, sf):
    return rounded(variance(spark, sf), 6, between_var=0, within_var=0, total_var=0, mean_daily=3, mean_weekly=3)


@check("w04_lag_correlation", "SELECT test_id, geo, round(rho, 6) AS rho FROM x_rho_geo")
def w04(spark, sf):
    return rounded(P.lag_correlations(P.weekly_totals(pre_panel(spark, sf), ["test_id"]), ["test_id"]))


def _eff(weeks: str) -> str:
    return f"greatest(CASE WHEN rho > 0 THEN {weeks} * (1 - rho) / (1 + rho) ELSE {weeks} END, 1.0)"


def _mde(nt: str, nh: str, weeks: str) -> str:
    return f"({ZSUM!r} * sqrt(within_var / {_eff(weeks)} / {nt} + within_var / {_eff(weeks)} / {nh}) / mean_weekly)"


def _power(effect: str, nt: str, nh: str, weeks: str) -> str:
    shift = f"({effect} * mean_weekly / sqrt(within_var / {_eff(weeks)} / {nt} + within_var / {_eff(weeks)} / {nh}))"
    return f"least(1 - {phi(f'{Z2!r} - {shift}')} + {phi(f'-{Z2!r} - {shift}')}, 1.0)"


view("x_mde", f"""
SELECT *, {_mde('n_treatment', 'n_holdout', 'weeks')} AS mde FROM (
  SELECT v.*, {N_HOLDOUT} AS n_holdout, n_geos - {N_HOLDOUT} AS n_treatment, CAST(w.weeks AS INTEGER) AS weeks FROM x_var v, range(1, 13) w(weeks))
""")


@check("d04_mde_grid", "SELECT test_id, weeks, round(mde, 6) AS mde FROM x_mde")
def d04(spark, sf):
    return rounded(P.mde_grid(sized_variance(spark, sf)).select("test_id", "weeks", "mde"))


@check("d05_achieved_power", f"""
SELECT test_id, weeks, e.effect, round({_power('e.effect', 'n_treatment', 'n_holdout', 'weeks')}, 6) AS power
FROM x_mde, (VALUES (0.05), (0.10), (0.20)) e(effect)
""")
def d05(spark, sf):
    g = P.weeks_grid(sized_variance(spark, sf), 1, 12).withColumn("effect", F.explode(F.array(F.lit(0.05), F.lit(0.10), F.lit(0.20))))
    p = P.achieved_power(F.col("effect"), F.col("n_treatment"), F.col("n_holdout"), F.col("weeks"))
    return g.select("test_id", "weeks", "effect", r(p).alias("power"))


@check("t05_required_duration", """
SELECT test_id, CAST(coalesce(min(weeks) FILTER (mde <= 0.25), 12) AS INTEGER) AS weeks FROM x_mde GROUP BY 1
""")
def t05(spark, sf):
    return P.required_duration(sized_variance(spark, sf), ["test_id"], 0.25)


view("x_power", f"""
SELECT *, {_power('mde', 'n_treatment', 'n_holdout', 'weeks')} AS power, mde * mean_weekly / sqrt(total_var) AS cohen_d FROM x_mde
WHERE (test_id, weeks) IN (SELECT test_id, coalesce(min(weeks) FILTER (mde <= 0.15), arg_min(weeks, mde)) FROM x_mde WHERE weeks >= 2 GROUP BY 1)
""")


@check("d06_power_result", """
SELECT test_id, weeks AS duration_weeks, round(mde, 6) AS mde, round(power, 6) AS power, round(cohen_d, 6) AS cohen_d, greatest(n_treatment, n_holdout) AS cell_size FROM x_power
""")
def d06(spark, sf):
    p = P.power_result(sized_variance(spark, sf), ["test_id"])
    return rounded(p.select("test_id", "duration_weeks", "mde", "power", "cohen_d", "cell_size"))


@check("d14_duration_curve", """
SELECT p.test_id, CAST(w.weeks AS INTEGER) AS weeks, round(mde * sqrt(p.weeks / w.weeks), 6) AS curve_mde FROM x_power p, range(1, 13) w(weeks)
""")
def d14(spark, sf):
    p = P.power_result(sized_variance(spark, sf), ["test_id"]).drop("weeks")
    return rounded(P.duration_curve(p).select("test_id", "weeks", "curve_mde"))


view("x_sizes", f"""
SELECT test_id, n_treatment, n_holdout, mde, 0.8 * (1 - mde / 0.15) - 0.1 * n_holdout / n_geos - 0.1 * abs(n_holdout - floor(n_geos * 0.25)) / n_geos AS score
FROM (SELECT v.*, CAST(n.i AS INTEGER) AS n_holdout, n_geos - n.i AS n_treatment, {_mde('(n_geos - n.i)', 'n.i', '12')} AS mde FROM x_var v, range(5, 13) n(i))
""")


@check("t04_holdout_sizes", "SELECT test_id, n_treatment, n_holdout, round(mde, 6) AS mde, round(score, 6) AS score FROM x_sizes")
def t04(spark, sf):
    return rounded(D.holdout_sizes(variance(spark, sf), ["test_id"]))


@check("t04_best_size", """
SELECT test_id, CAST(25 - n_holdout AS BIGINT) AS n_treatment, n_holdout FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, n_holdout) AS rk FROM x_sizes) WHERE rk = 1
""")
def t04b(spark, sf):
    return D.best_holdout_size(variance(spark, sf), ["test_id"])


# ---- balance and candidates -----------------------------------------------------------------

COVS = D.COVARIATES


def _smd_sql(c: str) -> str:
    f = lambda fn, cell: f"{fn}({c}) FILTER (cell = '{cell}')"
    sd = f"sqrt(({f('var_samp', 'treatment')} + {f('var_samp', 'holdout')}) / 2)"
    return f"CASE WHEN {sd} > 0 THEN abs({f('avg', 'treatment')} - {f('avg', 'holdout')}) / {sd} ELSE 0 END AS {c}"


SMDS = ", ".join(_smd_sql(c) for c in COVS)
view("x_matched", "SELECT a.test_id, a.cell, m.* FROM x_assign a JOIN x_matching m USING (geo)")
view("x_smd", f"SELECT test_id, {SMDS} FROM x_matched GROUP BY 1")


def matched(spark, sf):
    return matching(spark, sf).join(assignment(spark, sf), "geo")


@check("a13_covariate_balance", " UNION ALL ".join(f"SELECT test_id, '{c}' AS covariate, round({c}, 6) AS smd FROM x_smd" for c in COVS))
def a13(spark, sf):
    return rounded(D.covariate_balance(matched(spark, sf), ["test_id"]))


@check("a13_balance_score", f"""
SELECT test_id, round(greatest({', '.join(COVS)}), 6) AS max_smd, round(greatest(0, 1 - greatest({', '.join(COVS)}) / 0.5), 6) AS balance_score,
       greatest({', '.join(COVS)}) <= 0.10 AS is_balanced FROM x_smd
""")
def a13b(spark, sf):
    return rounded(D.balance_scores(matched(spark, sf), ["test_id"]))


@check("a14_cell_summary", """
SELECT test_id, cell, CAST(sum(population) AS BIGINT) AS population, round(sum(total_revenue), 4) AS revenue, CAST(sum(total_orders) AS BIGINT) AS orders,
       count(*) AS n_geos, string_agg(geo, ',' ORDER BY geo) AS geos FROM x_matched GROUP BY 1, 2
""")
def a14(spark, sf):
    return rounded(D.cell_summary(matched(spark, sf)).withColumn("geos", F.array_join("geos", ",")), 4)


N_CAND = 10_000
view("x_candidates", f"""
SELECT candidate, {SMDS} FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY candidate ORDER BY {h("'all'", 'candidate', 'geo')}, geo) <= {N_HOLDOUT} THEN 'holdout' ELSE 'treatment' END AS cell
  FROM x_matching, range({N_CAND}) c(candidate)) GROUP BY 1
""")
_G = f"greatest({', '.join(COVS)})"
view("x_best_cand", f"""
SELECT CAST(candidate AS INTEGER) AS candidate, {_G} AS max_smd, greatest(0, 1 - {_G} / 0.5) AS balance_score, {_G} <= 0.10 AS is_balanced
FROM x_candidates ORDER BY is_balanced DESC, balance_score DESC, candidate LIMIT 1
""")


def markets(spark, sf, tests: bool = True):
    m = matching(spark, sf).withColumn("n_holdout", F.lit(N_HOLDOUT))
    return per_test(spark, m) if tests else m.withColumn("test_id", F.lit("all"))


@check("d01_candidate_scores", f"SELECT 'all' AS test_id, CAST(candidate AS INTEGER) AS candidate, round({_G}, 6) AS max_smd, round(greatest(0, 1 - {_G} / 0.5), 6) AS balance_score, {_G} <= 0.10 AS is_balanced FROM x_candidates")
def d01(spark, sf):
    return rounded(D.candidate_scores(markets(spark, sf, False), N_CAND))


@check("d01_rerandomised", f"""
SELECT 'all' AS test_id, geo, CASE WHEN row_number() OVER (ORDER BY {h("'all'", 'candidate', 'geo')}, geo) <= {N_HOLDOUT} THEN 'holdout' ELSE 'treatment' END AS cell
FROM x_matching, x_best_cand
""")
def d01b(spark, sf):
    return D.rerandomised_assignment(markets(spark, sf, False), N_CAND).select("test_id", "geo", "cell")


@check("t03_best_candidate", "SELECT 'all' AS test_id, candidate, round(balance_score, 6) AS balance_score, round(max_smd, 6) AS max_smd, is_balanced FROM x_best_cand")
def t03(spark, sf):
    return rounded(D.best_candidate(D.candidate_scores(markets(spark, sf, False), N_CAND)))


# the whole matching by recursion: inverse of the correlations by elimination, then the shortest free pair at each step
_NC = len(COVS)
view("x_d2c", f"""
SELECT [{", ".join(f"stddev_samp({c})" for c in COVS)}] AS sd,
       [{", ".join("[" + ", ".join([f"corr({a}, {b})" for b in COVS] + ["1.0" if i == j else "0.0" for j in range(_NC)]) + "]" for i, a in enumerate(COVS))}] AS m FROM x_matching
""", stored=True)
view("x_d2i", """
SELECT 1 AS k, m FROM x_d2c UNION ALL
SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM x_d2i WHERE k <= len(m)
""")
view("x_d2e", f"""
SELECT a, b, sqrt(list_dot_product(u, list_transform(m, lambda r: list_dot_product(r[{_NC + 1}:], u)))) AS distance FROM (
  SELECT a.geo AS a, b.geo AS b, [{", ".join(f"(a.{c} - b.{c}) / sd[{i + 1}]" for i, c in enumerate(COVS))}] AS u FROM x_matching a JOIN x_matching b ON a.geo < b.geo, x_d2c), x_d2i WHERE k = {_NC + 1}
""", stored=True)
view("x_d2p", """
SELECT 0 AS step, CAST([] AS VARCHAR[]) AS used, {'d': 0.0, 'a': '', 'b': ''} AS e UNION ALL
SELECT step + 1, list_concat(used, [e.a, e.b]), e FROM (
  SELECT step, used, min({'d': distance, 'a': a, 'b': b}) AS e FROM x_d2p JOIN x_d2e ON NOT list_contains(used, a) AND NOT list_contains(used, b) GROUP BY step, used)
""", stored=True)


@check("d02_mahalanobis_assignment", f"""
SELECT test_id, geo, CASE WHEN EXISTS (
  SELECT 1 FROM x_d2p WHERE step BETWEEN 1 AND least({N_HOLDOUT}, (SELECT count(*) FROM x_matching) - {N_HOLDOUT}) AND geo = CASE WHEN {h('test_id', 'e.a', 'e.b')} % 2 = 0 THEN e.a ELSE e.b END)
  THEN 'holdout' ELSE 'treatment' END AS cell FROM x_matching, x_tests
""")
def d02(spark, sf):
    return D.mahalanobis_assignment(markets(spark, sf)).select("test_id", "geo", "cell")


# two covariates keep the inverse covariance short enough to write out
view("x_maha", """
SELECT a.geo AS a, b.geo AS b, sqrt((dx * dx * syy - 2 * dx * dy * sxy + dy * dy * sxx) / (sxx * syy - sxy * sxy)) AS distance
FROM (SELECT a.geo AS ga, b.geo AS gb, a.total_revenue - b.total_revenue AS dx, a.total_orders - b.total_orders AS dy FROM x_matching a JOIN x_matching b ON a.geo < b.geo) d
JOIN x_matching a ON a.geo = ga JOIN x_matching b ON b.geo = gb,
(SELECT var_samp(total_revenue) AS sxx, var_samp(total_orders) AS syy, covar_samp(total_revenue, total_orders) AS sxy FROM x_matching)
""")


@check("j17_mahalanobis_pairs", "SELECT 'all' AS test_id, a, b, round(distance, 4) AS distance FROM x_maha WHERE distance <= 1.5")
def j17(spark, sf):
    points = D.whitened(markets(spark, sf, False), ("total_revenue", "total_orders"))
    return rounded(D.close_pairs(points, 1.5), 4)


@check("d03_stratified", f"""
SELECT test_id, geo, region, CASE WHEN rk <= least(greatest(1, round_even(n * ({N_HOLDOUT}.0 / total), 0)), n - 1) THEN 'holdout' ELSE 'treatment' END AS cell
FROM (SELECT t.test_id, geo, region, row_number() OVER (PARTITION BY t.test_id, region ORDER BY {h('t.test_id', 'geo')}, geo) AS rk,
             count(*) OVER (PARTITION BY t.test_id, region) AS n, count(*) OVER (PARTITION BY t.test_id) AS total FROM x_geos, x_tests t)
""")
def d03(spark, sf):
    return A.stratified_assignment(per_test(spark, geos(spark, sf).select("geo", "region")), N_HOLDOUT)


@check("j07_cell_membership", """
SELECT test_id, cell, count(*) AS n, round(sum(p.revenue), 2) AS revenue FROM x_daily p JOIN x_assign USING (geo) GROUP BY 1, 2
""")
def j07(spark, sf):
    d = per_test(spark, daily(spark, sf))
    return rounded(A.with_cell(d, assignment(spark, sf)).groupBy("test_id", "cell").agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue")), 2)


# ---- back-test ------------------------------------------------------------------------------

POST_DAYS = 28
EFFECTS_SQL = "(VALUES (0.0), (0.05), (0.10), (0.15), (0.20)) e(effect)"
view("x_bt_dates", """
SELECT test_id, date, row_number() OVER (PARTITION BY test_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY test_id) AS n FROM (SELECT DISTINCT test_id, date FROM x_pre)
""")
view("x_bt_bounds", f"""
SELECT test_id, n, lo, CASE WHEN n - {POST_DAYS} <= lo THEN lo + 1 ELSE n - {POST_DAYS} END AS hi FROM (
  SELECT test_id, max(n) AS n, CASE WHEN greatest(14, max(n) - 3 * {POST_DAYS}) > max(n) - {POST_DAYS} THEN 14 ELSE greatest(14, max(n) - 3 * {POST_DAYS}) END AS lo
  FROM x_bt_dates GROUP BY 1 HAVING max(n) >= {POST_DAYS} + 14)
""")
view("x_bt_splits", f"""
SELECT test_id, split, least(split + {POST_DAYS}, n - 1) AS last FROM (SELECT test_id, n, unnest(generate_series(lo, hi)) AS split FROM x_bt_bounds)
""")
view("x_bt_geo", """
SELECT s.test_id, s.split, p.geo, p.cell, avg(revenue) FILTER (d.idx < s.split) AS pre_mean, avg(revenue) FILTER (d.idx >= s.split AND d.idx <= s.last) AS post_mean
FROM x_bt_splits s JOIN x_pre p ON p.test_id = s.test_id JOIN x_bt_dates d ON d.test_id = p.test_id AND d.date = p.date GROUP BY 1, 2, 3, 4
""")
view("x_bt_stats", f"""
SELECT test_id, split, effect, CASE WHEN nt >= 2 AND nh >= 2 AND sc > 0 THEN tau / sc END AS t_stat, CASE WHEN nt >= 2 AND nh >= 2 AND sc > 0 THEN nt + nh - 2 END AS dof
FROM (SELECT *, sqrt(((nt - 1) * vt + (nh - 1) * vh) / (nt + nh - 2) * (1.0 / nt + 1.0 / nh)) AS sc FROM (
  SELECT test_id, split, effect, avg(diff) FILTER (cell = 'treatment') - avg(diff) FILTER (cell = 'holdout') AS tau, var_samp(diff) FILTER (cell = 'treatment') AS vt,
         var_samp(diff) FILTER (cell = 'holdout') AS vh, count(diff) FILTER (cell = 'treatment') AS nt, count(diff) FILTER (cell = 'holdout') AS nh
  FROM (SELECT *, post_mean * (1 + CASE WHEN cell = 'treatment' THEN effect ELSE 0 END) - pre_mean AS diff FROM x_bt_geo, {EFFECTS_SQL}) GROUP BY 1, 2, 3
  HAVING count(diff) FILTER (cell = 'treatment') > 0 AND count(diff) FILTER (cell = 'holdout') > 0))
""")


@check("d07_backtest_t", "SELECT test_id, CAST(split AS INTEGER) AS split, effect, round(t_stat, 5) AS t_stat, dof FROM x_bt_stats")
def d07(spark, sf):
    return rounded(P.backtest_statistics(pre_panel(spark, sf), POST_DAYS), 5)


@check("d07_backtest_plan", f"""
SELECT test_id, effect, CAST(rep AS INTEGER) AS rep, CAST(lo + {h('test_id', 'arm', 'rep')} % (hi + 1 - lo) AS INTEGER) AS split
FROM x_bt_bounds, (VALUES (0.0, 0, 50), (0.05, 1, 200), (0.10, 2, 200), (0.15, 3, 200), (0.20, 4, 200)) e(effect, arm, n_rep), range(200) b(rep) WHERE rep < n_rep
""")
def d07b(spark, sf):
    return P.backtest_plan(P.backtest_bounds(pre_panel(spark, sf), POST_DAYS), 200)


@check("d07_backtest_power", f"""
SELECT b.test_id, b.effect, count(*) AS n_sims, round(avg(CASE WHEN {student_p('t_stat', 'dof')} < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS detected FROM (
  SELECT test_id, effect, lo + {h('test_id', 'arm', 'rep')} % (hi + 1 - lo) AS split
  FROM x_bt_bounds, (VALUES (0.0, 0, 50), (0.05, 1, 200), (0.10, 2, 200), (0.15, 3, 200), (0.20, 4, 200)) e(effect, arm, n_rep), range(200) b(rep) WHERE rep < n_rep) b
LEFT JOIN x_bt_stats s USING (test_id, effect, split) GROUP BY 1, 2
""")
def d07c(spark, sf):
    return rounded(P.backtest_power(pre_panel(spark, sf), POST_DAYS, 200))


@check("d08_power_score", """
SELECT test_id, weeks, round(least(100, CASE WHEN power >= 0.8 THEN 40 ELSE 40 * power / 0.8 END + CASE WHEN f <= 0.06 THEN 20 WHEN f <= 0.1 THEN 15 WHEN f <= 0.15 THEN 8 ELSE 0 END + m + s), 4) AS score,
       round(least(100, CASE WHEN power >= 0.8 THEN 40 ELSE 40 * power / 0.8 END + 15 + m + s), 4) AS analytical_score
FROM (SELECT test_id, weeks, least(greatest(cv, 0), 1) AS power, weeks / 60.0 AS f, CASE WHEN mde <= 0.1 THEN 25 WHEN mde <= 0.15 THEN 20 WHEN mde <= 0.2 THEN 12 WHEN mde <= 0.3 THEN 5 ELSE 0 END AS m,
             CASE WHEN weeks * 2 >= 20 THEN 15 WHEN weeks * 2 >= 10 THEN 10 WHEN weeks * 2 >= 5 THEN 5 ELSE 0 END AS s FROM x_mde)
""")
def d08(spark, sf):
    g = P.mde_grid(sized_variance(spark, sf))
    power, n = F.least(F.greatest("cv", F.lit(0.0)), F.lit(1.0)), F.col("weeks") * 2
    return g.select("test_id", "weeks", r(P.power_score(power, F.col("weeks") / 60.0, F.col("mde"), n), 4).alias("score"),
                    r(P.analytical_power_score(power, F.col("mde"), n), 4).alias("analytical_score"))


view("x_feas", """
SELECT p.*, (weeks % 4) / 5.0 AS sim_power, weeks / 60.0 AS fpr, (SELECT sum(total_revenue) FROM x_matched m WHERE m.test_id = p.test_id AND cell = 'holdout') AS hold,
       least(100, CASE WHEN pw >= 0.8 THEN 40 ELSE 40 * pw / 0.8 END + 15 + CASE WHEN mde <= 0.1 THEN 25 WHEN mde <= 0.15 THEN 20 WHEN mde <= 0.2 THEN 12 WHEN mde <= 0.3 THEN 5 ELSE 0 END
         + CASE WHEN n_holdout >= 20 THEN 15 WHEN n_holdout >= 10 THEN 10 WHEN n_holdout >= 5 THEN 5 ELSE 0 END) AS score
FROM (SELECT *, weeks / 12.0 AS pw FROM x_mde) p
""")


@check("d09_feasibility", """
SELECT test_id, weeks, concat_ws(',', CASE WHEN n_holdout < 5 THEN 'few_holdout' END, CASE WHEN n_treatment < 5 THEN 'few_treatment' END, CASE WHEN n_periods < 4 THEN 'short_history' END,
         CASE WHEN mde > 0.3 THEN 'mde' END, CASE WHEN sim_power > 0 AND sim_power < 0.5 THEN 'power' END, CASE WHEN score < 50 THEN 'score' END, CASE WHEN fpr > 0.15 THEN 'false_positives' END) AS blockers,
       concat_ws(',', CASE WHEN mde > 0.2 AND mde <= 0.3 THEN 'mde' END, CASE WHEN sim_power >= 0.5 AND sim_power < 0.7 THEN 'power' END, CASE WHEN sim_power <= 0 AND pw < 0.6 THEN 'analytical_power' END,
         CASE WHEN score < 70 AND score >= 50 THEN 'score' END, CASE WHEN fpr > 0.1 AND fpr <= 0.15 THEN 'false_positives' END) AS warnings,
       round(hold / greatest(n_periods, 1) * weeks * mde, 2) AS opportunity_cost FROM x_feas
""")
def d09(spark, sf):
    hold = matched(spark, sf).filter("cell = 'holdout'").groupBy("test_id").agg(F.sum("total_revenue").alias("holdout_revenue"))
    facts = P.mde_grid(sized_variance(spark, sf)).withColumn("power", F.col("weeks") / 12.0).withColumn("sim_power", (F.col("weeks") % 4) / 5.0)
    facts = facts.withColumn("fpr", F.col("weeks") / 60.0).withColumn("power_score", F.lit(0.0)).withColumn("duration_weeks", F.col("weeks")).join(hold, "test_id")
    f = D.feasibility(facts)
    return f.select("test_id", "weeks", F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"),
                    r(F.col("opportunity_cost"), 2).alias("opportunity_cost"))


# ---- geography ------------------------------------------------------------------------------


def _hav(a1, o1, a2, o2):
    return (f"2.0 * 3959.0 * asin(sqrt(least(1.0, pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2))))")


# real places are stretched out of the nation list; 400 miles gives every market a few neighbours
view("x_edges", f"""
SELECT a.geo AS src, b.geo AS dst, {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS miles FROM x_geos a JOIN x_geos b ON a.geo <> b.geo
WHERE {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 400
""")


def edges(spark, sf):
    return X.centroid_edges(geos(spark, sf), 400.0)


@check("j08_centroid_edges", "SELECT src, dst, round(miles, 6) AS miles FROM x_edges")
def j08(spark, sf):
    return rounded(edges(spark, sf))


@check("j08_neighbour_stats", """
SELECT count(*) AS n_geos, round(avg(n), 6) AS avg_neighbours, max(n) AS max_neighbours, count(*) FILTER (n = 0) AS n_isolated, CAST(sum(n) // 2 AS BIGINT) AS n_edges
FROM (SELECT g.geo, count(e.dst) AS n FROM x_geos g LEFT JOIN x_edges e ON e.src = g.geo GROUP BY 1)
""")
def j08b(spark, sf):
    return rounded(X.neighbour_stats(geos(spark, sf), edges(spark, sf)))


@check("f05_haversine", f"SELECT geo, round({_hav('lat', 'lon', '40.0', '-75.0')}, 4) AS miles FROM x_geos")
def f05(spark, sf):
    return geos(spark, sf).select("geo", r(S.haversine_miles(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-75.0)), 4).alias("miles"))


@check("f06_normal_cdf", f"SELECT l_orderkey, l_linenumber, l_partkey, round({phi('(l_quantity - 25) / 8')}, 6) AS p FROM lineitem")
def f06(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(normal_cdf((F.col("l_quantity") - 25) / 8)).alias("p"))


view("x_border", """
SELECT t.test_id, e.src AS treatment_geo, e.dst AS holdout_geo FROM x_edges e JOIN x_assign t ON t.geo = e.src AND t.cell = 'treatment'
JOIN x_assign h ON h.geo = e.dst AND h.cell = 'holdout' AND h.test_id = t.test_id
""")


@check("j09_border_pairs", "SELECT * FROM x_border")
def j09(spark, sf):
    return X.border_pairs(edges(spark, sf), assignment(spark, sf))


view("x_risk", """
SELECT a.test_id, n AS n_holdout, coalesce(p, 0) AS n_border_pairs, coalesce(nh, 0) AS n_contaminated_holdout, coalesce(nt, 0) AS n_contaminated_treatment,
       coalesce(nh, 0) / n AS risk_score FROM (SELECT test_id, count(*) AS n FROM x_assign WHERE cell = 'holdout' GROUP BY 1) a
LEFT JOIN (SELECT test_id, count(*) AS p, count(DISTINCT holdout_geo) AS nh, count(DISTINCT treatment_geo) AS nt FROM x_border GROUP BY 1) b USING (test_id)
""")


@check("d10_spillover_risk", """
SELECT *, round(1 - risk_score, 6) AS clean_holdout_share, CASE WHEN risk_score > 0.3 THEN 'high' WHEN risk_score > 0.1 THEN 'moderate' WHEN n_contaminated_holdout > 0 THEN 'low' ELSE 'none' END AS risk_level FROM x_risk
""")
def d10(spark, sf):
    return rounded(X.spillover_risk(edges(spark, sf), assignment(spark, sf)))


view("x_contacts", """
SELECT test_id, holdout_geo, n_contacts, CAST(row_number() OVER (PARTITION BY test_id ORDER BY n_contacts DESC, holdout_geo) AS INTEGER) AS rank
FROM (SELECT test_id, holdout_geo, count(DISTINCT treatment_geo) AS n_contacts FROM x_border GROUP BY 1, 2)
""")


@check("t07_contact_counts", "SELECT * FROM x_contacts")
def t07(spark, sf):
    return X.contact_counts(X.border_pairs(edges(spark, sf), assignment(spark, sf)))


def _buffer_sql(least: int) -> str:
    return f"""
SELECT test_id, geo, region, cell, mode AS buffer_mode, CASE mode WHEN 'full' THEN c.rank IS NOT NULL OR t.treatment_geo IS NOT NULL
       WHEN 'partial' THEN coalesce(cell = 'holdout' AND c.rank <= n_holdout - {least}, false) ELSE false END AS in_buffer
FROM x_assign a JOIN (SELECT *, CASE WHEN n_contaminated_holdout = 0 THEN 'none' WHEN n_holdout - n_contaminated_holdout >= {least} THEN 'full'
                                     WHEN n_holdout - {least} > 0 THEN 'partial' ELSE 'none' END AS mode FROM x_risk) USING (test_id)
LEFT JOIN (SELECT test_id, holdout_geo AS geo, rank FROM x_contacts) c USING (test_id, geo)
LEFT JOIN (SELECT DISTINCT test_id, treatment_geo, treatment_geo AS geo FROM x_border) t USING (test_id, geo)"""


@check("d11_buffer_partial", _buffer_sql(5))
def d11(spark, sf):
    return X.geographic_buffer(edges(spark, sf), assignment(spark, sf), 5)


@check("d11_buffer_full", _buffer_sql(1))
def d11b(spark, sf):
    return X.geographic_buffer(edges(spark, sf), assignment(spark, sf), 1)


# ---- spillover-adjusted results -------------------------------------------------------------


@check("c23_spillover_adjusted", """
SELECT test_id, round(f, 6) AS spillover_factor, round(absolute_lift * f, 3) AS absolute_lift, round(relative_lift * f, 6) AS relative_lift,
       round(lift_lower_ci * f, 6) AS lift_lower_ci, round(lift_upper_ci * f, 6) AS lift_upper_ci
FROM (SELECT d.*, CASE WHEN risk_score > 0.1 THEN 1.0 / (1.0 - risk_score * 0.2) ELSE 1 END AS f FROM x_did_w d JOIN x_risk USING (test_id))
""")
def c23(spark, sf):
    from liftfield.operators.causal import difference_in_differences
    from liftfield.operators.returns import spillover_adjusted

    s = spillover_adjusted(difference_in_differences(panel(spark, sf, "weekly")), X.spillover_risk(edges(spark, sf), assignment(spark, sf)))
    return rounded(s.select("test_id", "spillover_factor", "absolute_lift", "relative_lift", "lift_lower_ci", "lift_upper_ci"), 6, absolute_lift=3)


# ---- lifecycle ------------------------------------------------------------------------------

view("x_life", """
SELECT 'test_' || o_custkey AS test_id, CAST(o_orderdate AS DATE) AS day, o_orderkey AS seq,
       ['execute', 'update', 'revert', 'execute', 'update', 'revert', 'execute', 'analyze'][CAST(o_orderkey % 8 AS INTEGER) + 1] AS action FROM orders
""")


@check("d13_lifecycle", """
SELECT test_id, seq, action, state_before, CASE action WHEN 'execute' THEN state_before IN ('designed', 'completed') WHEN 'update' THEN state_before = 'running'
       WHEN 'revert' THEN state_before IN ('running', 'completed') ELSE true END AS is_allowed
FROM (SELECT *, CASE WHEN a THEN 'analyzed' WHEN NOT s THEN 'designed' WHEN m = 'execute' THEN 'running' ELSE 'completed' END AS state_before FROM (
  SELECT *, coalesce(bool_or(action = 'analyze') OVER w, false) AS a, coalesce(bool_or(action = 'execute') OVER w, false) AS s,
         last_value(CASE WHEN action IN ('execute', 'revert') THEN action END IGNORE NULLS) OVER w AS m FROM x_life
  WINDOW w AS (PARTITION BY test_id ORDER BY day, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
""")
def d13(spark, sf):
    actions = F.array(*[F.lit(a) for a in ("execute", "update", "revert", "execute", "update", "revert", "execute", "analyze")])
    e = table(spark, sf, "orders").select(
        F.concat(F.lit("test_"), F.col("o_custkey").cast("string")).alias("test_id"), F.col("o_orderdate").cast("date").alias("at"),
        F.col("o_orderkey").alias("seq"), F.element_at(actions, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("action"))
    return D.lifecycle(e).select("test_id", "seq", "action", "state_before", "is_allowed")
