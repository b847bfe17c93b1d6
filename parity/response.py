"""Spend response of the test that overlaps the spend period."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.functions import scalars as S
from liftfield.operators import response as H
from parity.common import check, h, panel, r, rounded, spend_daily, table, tests_table, view

CAUSAL = 2.5


def hill(x, rr, k, a):
    return f"({rr}) * pow(greatest({x}, 1e-10), {a}) / (pow(greatest({k}, 1e-10), {a}) + pow(greatest({x}, 1e-10), {a}))"


def slope(s, rr, k, a):
    den = f"pow(pow({k}, {a}) + pow(greatest({s}, 1e-10), {a}), 2)"
    return f"CASE WHEN {den} < 1e-20 THEN 0 ELSE ({rr}) * {a} * pow({k}, {a}) * pow(greatest({s}, 1e-10), {a} - 1) / {den} END"


view("x_gspend", """
SELECT t.test_id, s.geo, s.date, s.spend FROM x_tests t JOIN (SELECT date, geo, sum(spend) AS spend FROM x_spend GROUP BY 1, 2) s ON s.date BETWEEN start_date AND end_date
""")
view("x_levels", """
SELECT test_id, geo, cell, coalesce(pre_avg, 0) AS pre_avg, coalesce(post_avg, 0) AS post_avg, coalesce(spend_avg, 0) AS spend_avg
FROM (SELECT test_id, geo, cell, avg(revenue) FILTER (period = 'pre') AS pre_avg, avg(revenue) FILTER (period = 'post') AS post_avg FROM x_panel GROUP BY 1, 2, 3)
FULL JOIN (SELECT test_id, geo, avg(spend) AS spend_avg FROM x_gspend GROUP BY 1, 2) USING (test_id, geo)
""")
view("x_points", """
SELECT test_id, geo, spend_avg AS x, post_avg - pre_avg * g AS y, g AS organic_growth FROM x_levels JOIN (
  SELECT test_id, avg(post_avg) FILTER (cell = 'holdout') / avg(pre_avg) FILTER (cell = 'holdout') AS g FROM x_levels GROUP BY 1
  HAVING count(*) FILTER (cell = 'holdout') >= 2 AND count(*) FILTER (cell = 'treatment') >= 3 AND count(*) FILTER (cell = 'treatment' AND spend_avg > 0) >= 3) USING (test_id)
WHERE cell = 'treatment' AND spend_avg > 0
""")


def points(spark, sf):
    t = tests_table(spark)
    days = t.select("test_id", F.explode(F.sequence("start_date", "end_date")).alias("date"))
    s = spend_daily(spark, sf).groupBy("date", "geo").agg(F.sum("spend").alias("spend")).join(days, "date")
    return H.response_points(levels(spark, sf, s))


def levels(spark, sf, s=None):
    if s is None:
        days = tests_table(spark).select("test_id", F.explode(F.sequence("start_date", "end_date")).alias("date"))
        s = spend_daily(spark, sf).groupBy("date", "geo").agg(F.sum("spend").alias("spend")).join(days, "date")
    return H.market_levels(panel(spark, sf), s)


@check("j11_market_levels", "SELECT test_id, geo, cell, round(pre_avg, 6) AS pre_avg, round(post_avg, 6) AS post_avg, round(spend_avg, 6) AS spend_avg FROM x_levels")
def j11(spark, sf):
    return rounded(levels(spark, sf), 6)


@check("h01_response_points", "SELECT test_id, geo, round(x, 4) AS x, round(y, 3) AS y, round(organic_growth, 6) AS organic_growth FROM x_points")
def h01(spark, sf):
    return rounded(points(spark, sf), 4, y=3, organic_growth=6)


def fit_views(tag: str, src: str, keys: str) -> None:
    """x_fit_<tag> from a view with keys, x, y, w, k0 (anchor rows included)."""
    def best(name: str, cells: str) -> None:
        view(f"x_{name}_{tag}", f"""
        SELECT {keys}, k, alpha, r AS r_max FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sse, k, alpha) AS rk FROM (
          SELECT *, syy - 2 * r * syh + r * r * shh AS sse FROM (
            SELECT *, greatest(syh / shh, 0.0) AS r FROM (SELECT {keys}, k, alpha, sum(w * y * hh) AS syh, sum(w * hh * hh) AS shh FROM (
              SELECT *, {hill('x', '1.0', 'k', 'alpha')} AS hh FROM ({cells})) GROUP BY {keys}, k, alpha)
            JOIN (SELECT {keys}, sum(w * y * y) AS syy FROM {src} GROUP BY {keys}) USING ({keys})))) WHERE rk = 1""")

    best("coarse", f"SELECT p.*, k0 * pow(10.0, i / 10.0) AS k, j / 10.0 AS alpha FROM {src} p, range(-20, 21) a(i), range(1, 31) b(j)")
    best("fit", f"""SELECT DISTINCT p.*, c.k * pow(10.0, i / 200.0) AS k, least(greatest(c.alpha + j / 100.0, 0.1), 3.0) AS alpha
    FROM {src} p JOIN x_coarse_{tag} c USING ({keys}), range(-20, 21) a(i), range(-10, 11) b(j)""")


view("x_fitpts", """
SELECT test_id, x, y, 1.0 AS w, k0, geo FROM x_points JOIN (SELECT test_id, median(x) AS k0 FROM x_points GROUP BY 1) USING (test_id)
UNION ALL SELECT test_id, 0.0, 0.0, 1.0, median(x), '' FROM x_points GROUP BY 1
""")
fit_views("pt", "x_fitpts", "test_id")


@check("h02_hill_fit", "SELECT test_id, round(r_max, 2) AS r_max, round(k, 4) AS k, round(alpha, 4) AS alpha, true AS converged FROM x_fit_pt")
def h02(spark, sf):
    return rounded(H.fit_response(points(spark, sf)), 4, r_max=2)


view("x_curve", f"""
SELECT test_id, f.k, f.alpha, f.r_max * CASE WHEN p > 0.000001 THEN {CAUSAL} / p ELSE 1 END AS r_max, p > 0.000001 AS calibrated
FROM x_fit_pt f JOIN (SELECT test_id, sum({hill('x', 'r_max', 'k', 'alpha')}) / sum(x) AS p FROM x_points JOIN x_fit_pt USING (test_id) GROUP BY 1) USING (test_id)
""")


def causal(spark):
    return tests_table(spark).select("test_id", F.lit(CAUSAL).alias("iroas"))


def curves(spark, sf):
    p = points(spark, sf)
    return H.calibrate(H.fit_response(p), p, causal(spark)), p


@check("h03_calibrated_curve", "SELECT test_id, round(r_max, 2) AS r_max, calibrated FROM x_curve")
def h03(spark, sf):
    return rounded(curves(spark, sf)[0].select("test_id", "r_max", "calibrated"), 2)


def optimum_view(name: str, src: str, keys: str) -> None:
    """src: keys, r_max, k, alpha, current."""
    view(name, f"""
    SELECT {keys}, coalesce(min(s) FILTER (low), max(s)) AS optimal FROM (SELECT *, {slope('s', 'r_max', 'k', 'alpha')} < 1.0 AS low FROM (
      SELECT *, 0.01 + (greatest(current * 3, k * 5) - 0.01) * i / 9999 AS s FROM {src}, range(10000) g(i))) GROUP BY {keys}""")


view("x_state", "SELECT c.*, current, x_max, n_geos FROM x_curve c JOIN (SELECT test_id, avg(x) AS current, max(x) AS x_max, count(*) AS n_geos FROM x_points GROUP BY 1) USING (test_id)")
optimum_view("x_optimum", "x_state", "test_id")


@check("t06_optimal_spend", "SELECT test_id, round(optimal, 4) AS optimal FROM x_optimum")
def t06(spark, sf):
    c, p = curves(spark, sf)
    by = p.groupBy("test_id").agg(F.avg("x").alias("current"))
    return rounded(H.optimal_spend(c.join(by, "test_id"), ["test_id"]), 4)


view("x_rsq", f"""
SELECT test_id, 1 - sum(pow(y - {hill('x', 'r_max', 'k', 'alpha')}, 2)) / (var_pop(y) * count(*)) AS r_squared
FROM (SELECT test_id, x, y FROM x_fitpts) JOIN x_curve USING (test_id) GROUP BY 1
""")
view("x_opt_state", "SELECT s.*, optimal, (optimal - current) / current * 100 AS change FROM x_state s JOIN x_optimum USING (test_id)")


@check("h04_response_summary", f"""
SELECT test_id, round(r_max, 2) AS r_max, round(k, 4) AS k, round(alpha, 4) AS alpha, n_geos, round(r_squared, 6) AS r_squared, round(current * n_geos, 4) AS current_spend,
       round({hill('current', 'r_max', 'k', 'alpha')} / current, 4) AS current_iroas, round({slope('current', 'r_max', 'k', 'alpha')}, 4) AS current_marginal,
       round(optimal * n_geos, 4) AS optimal_spend, round({hill('optimal', 'r_max', 'k', 'alpha')} / optimal, 4) AS optimal_iroas, round(change, 4) AS spend_change_pct,
       CASE WHEN change < -10 THEN 'decrease' WHEN change > 10 THEN 'increase' ELSE 'maintain' END AS direction, optimal > x_max * 1.2 AS is_extrapolated
FROM x_opt_state JOIN x_rsq USING (test_id)
""")
def h04(spark, sf):
    c, p = curves(spark, sf)
    return rounded(H.response_summary(c, p), 4, r_max=2, r_squared=6)


N_BOOT = 200
view("x_pidx", "SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY geo) - 1 AS idx, count(*) OVER (PARTITION BY test_id) AS n, median(x) OVER (PARTITION BY test_id) AS k0 FROM x_points")
view("x_bpts", f"""
SELECT p.test_id, b.rep, p.x, p.y, b.w, p.k0 FROM (
  SELECT test_id, rep, pick, CAST(count(*) AS DOUBLE) AS w FROM (SELECT i.test_id, r.rep, {h('i.test_id', 'r.rep', 'i.idx')} % i.n AS pick FROM x_pidx i, range({N_BOOT}) r(rep)) GROUP BY 1, 2, 3) b
JOIN x_pidx p ON p.test_id = b.test_id AND p.idx = b.pick
UNION ALL SELECT test_id, rep, 0.0, 0.0, 1.0, median(x) FROM x_points, range({N_BOOT}) r(rep) GROUP BY 1, 2
""")
fit_views("bt", "x_bpts", "test_id, rep")
view("x_bcurve", f"""
SELECT test_id, rep, f.k, f.alpha, f.r_max * CASE WHEN p > 0.000001 THEN {CAUSAL} / p ELSE 1 END AS r_max, current
FROM x_fit_bt f JOIN (SELECT test_id, rep, sum(w * {hill('x', 'r_max', 'k', 'alpha')}) / sum(w * x) AS p FROM (SELECT * FROM x_bpts WHERE x > 0) JOIN x_fit_bt USING (test_id, rep) GROUP BY 1, 2) USING (test_id, rep)
JOIN (SELECT test_id, avg(x) AS current FROM x_points GROUP BY 1) USING (test_id)
""")
optimum_view("x_bopt", "x_bcurve", "test_id, rep")


@check("h05_optimum_interval", """
SELECT test_id, count(*) AS n_fits, round(quantile_cont(optimal, 0.025), 4) AS optimal_lower, round(quantile_cont(optimal, 0.975), 4) AS optimal_upper FROM x_bopt GROUP BY 1
""")
def h05(spark, sf):
    return rounded(H.optimum_interval(H.bootstrap_curves(points(spark, sf), causal(spark), n_boot=N_BOOT)), 4)


view("x_chart", """
SELECT *, 0.01 + (greatest(current * 2.5, optimal * 1.5, x_max * 1.5) - 0.01) * i / 99 AS s FROM x_opt_state, range(100) g(i)
""")


@check("h06_curve_table", f"""
SELECT test_id, CAST(i AS INTEGER) AS i, round(s * n_geos, 4) AS spend, round({hill('s', 'r_max', 'k', 'alpha')} * n_geos, 3) AS revenue, round(low * n_geos, 3) AS revenue_lower,
       round(high * n_geos, 3) AS revenue_upper, round({slope('s', 'r_max', 'k', 'alpha')}, 4) AS marginal, round({hill('s', 'r_max', 'k', 'alpha')} / s, 4) AS avg_return
FROM x_chart JOIN (SELECT c.test_id, c.i, quantile_cont({hill('c.s', 'b.r_max', 'b.k', 'b.alpha')}, 0.025) AS low, quantile_cont({hill('c.s', 'b.r_max', 'b.k', 'b.alpha')}, 0.975) AS high
      FROM x_chart c JOIN x_bcurve b ON b.test_id = c.test_id GROUP BY 1, 2) USING (test_id, i)
""")
def h06(spark, sf):
    c, p = curves(spark, sf)
    boot = H.bootstrap_curves(p, causal(spark), n_boot=N_BOOT)
    return rounded(H.curve_table(c, p, boot), 4, revenue=3, revenue_lower=3, revenue_upper=3)


# ---- scalar curves on line items ------------------------------------------------------------

_LI = "SELECT l_orderkey, l_linenumber, l_partkey,"


@check("f01_hill_revenue", f"{_LI} round({hill('l_extendedprice', '1000', '30000', '0.7')}, 5) AS v FROM lineitem")
def f01(spark, sf):
    v = S.hill_revenue(F.col("l_extendedprice"), F.lit(1000.0), F.lit(30000.0), F.lit(0.7))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(v, 5).alias("v"))


@check("f02_hill_slope", f"{_LI} round({slope('l_quantity', '1000', '20.0', '1.5')}, 6) AS v FROM lineitem")
def f02(spark, sf):
    v = S.hill_slope(F.col("l_quantity"), F.lit(1000.0), F.lit(20.0), F.lit(1.5))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(v).alias("v"))


def share(x, a, g):
    return f"pow(greatest({x}, 0), {a}) / (pow(greatest({x}, 0), {a}) + pow({g}, {a}))"


@check("f03_hill_share", f"{_LI} round({share('l_quantity - 10', '1.3', '20.0')}, 6) AS v FROM lineitem")
def f03(spark, sf):
    v = S.hill_share(F.col("l_quantity") - 10, F.lit(1.3), F.lit(20.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(v).alias("v"))


@check("f04_central_marginal", f"""
{_LI} round(({hill('x + st / 2', '500000', '40000.0', '0.9')} - {hill('greatest(x - st / 2, 0)', '500000', '40000.0', '0.9')}) / st, 6) AS v
FROM (SELECT *, l_extendedprice AS x, greatest(l_extendedprice * 0.01, 100) AS st FROM lineitem)
""")
def f04(spark, sf):
    x = F.col("l_extendedprice")
    v = S.central_marginal(lambda s: S.hill_revenue(s, F.lit(500000.0), F.lit(40000.0), F.lit(0.9)), x, S.marginal_step(x))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(v).alias("v"))
