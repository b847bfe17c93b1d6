"""Panel reshaping, quality findings and window measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.operators import panel as P
from liftfield.operators import quality as Q
from parity.common import assignment, check, panel, rounded, tests_table, view

# ---- sets and fills -------------------------------------------------------------------------

view("x_donors", """
SELECT test_id, geo FROM x_wpanel WHERE cell = 'holdout' GROUP BY 1, 2 HAVING count(DISTINCT period) = 2
""")
view("x_common_dates", """
SELECT p.test_id, p.period, p.date FROM x_wpanel p LEFT JOIN x_donors d ON d.test_id = p.test_id AND d.geo = p.geo
GROUP BY 1, 2, 3 HAVING bool_or(cell = 'treatment') AND bool_or(d.geo IS NOT NULL)
""")
view("x_grid", """
SELECT c.test_id, c.period, c.date, d.geo AS unit, p.revenue AS v FROM x_common_dates c JOIN x_donors d USING (test_id)
LEFT JOIN x_wpanel p ON p.test_id = c.test_id AND p.period = c.period AND p.date = c.date AND p.geo = d.geo
""")
view("x_filled", """
SELECT test_id, period, date, unit, coalesce(
  last_value(v IGNORE NULLS) OVER (PARTITION BY test_id, unit, period ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY test_id, unit, period ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS y
FROM x_grid
""")
view("x_aligned", """
SELECT test_id, period, date, '*treatment*' AS unit, avg(revenue) AS y FROM x_wpanel JOIN x_common_dates USING (test_id, period, date)
WHERE cell = 'treatment' GROUP BY 1, 2, 3 UNION ALL SELECT * FROM x_filled
""")


@check("u03_common_donors", "SELECT test_id, geo FROM x_donors")
def u03(spark, sf):
    return P.common_donors(panel(spark, sf, "weekly"))


@check("u03_common_dates", "SELECT test_id, period, date FROM x_common_dates")
def u03b(spark, sf):
    return P.common_dates(panel(spark, sf, "weekly"))


@check("w03_filled_donors", "SELECT test_id, period, date, unit, round(y, 2) AS y FROM x_filled")
def w03(spark, sf):
    return rounded(P.fill_donor_grid(panel(spark, sf, "weekly")), 2)


@check("q01_aligned_series", "SELECT test_id, period, date, unit, round(y, 4) AS y FROM x_aligned")
def q01(spark, sf):
    return rounded(P.aligned_series(panel(spark, sf, "weekly")), 4)


# a planned market that never sold, and a test that never ran
view("x_assign_plus", """
SELECT test_id, geo, cell FROM x_assign UNION ALL SELECT 't1', 'nowhere', 'holdout' UNION ALL SELECT 't0', geo, cell FROM x_assign WHERE test_id = 't1'
""")


def assignment_plus(spark, sf):
    a = assignment(spark, sf).select("test_id", "geo", "cell")
    nowhere = tests_table(spark).filter("test_id = 't1'").select("test_id", F.lit("nowhere").alias("geo"), F.lit("holdout").alias("cell"))
    return a.unionByName(nowhere).unionByName(a.filter("test_id = 't1'").withColumn("test_id", F.lit("t0")))


@check("u02_coverage_gaps", """
SELECT test_id, a.geo, a.cell, p.period FROM x_assign_plus a, (VALUES ('pre'), ('post')) p(period)
WHERE NOT EXISTS (SELECT 1 FROM x_panel q WHERE q.test_id = a.test_id AND q.geo = a.geo AND q.period = p.period)
""")
def u02(spark, sf):
    return P.coverage_gaps(panel(spark, sf), assignment_plus(spark, sf))


@check("w11_split_points", """
SELECT test_id, CAST(s.i AS INTEGER) AS split, date AS split_date, idx AS n_pre FROM (
  SELECT test_id, date, row_number() OVER (PARTITION BY test_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY test_id) AS n
  FROM (SELECT DISTINCT test_id, date FROM x_panel WHERE period = 'pre')), range(5) s(i)
WHERE n >= 21 AND idx = floor(floor(n * 0.3) + (floor(n * 0.7) - floor(n * 0.3)) * (s.i / 4) + 0.000000001)
""")
def w11(spark, sf):
    return P.split_points(panel(spark, sf))


@check("w11_median_split", """
SELECT test_id, CAST(0 AS INTEGER) AS split, date AS split_date FROM (
  SELECT test_id, date, row_number() OVER (PARTITION BY test_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY test_id) AS n
  FROM (SELECT DISTINCT test_id, date FROM x_panel WHERE period = 'pre')) WHERE n >= 14 AND idx = n // 2
""")
def w11b(spark, sf):
    return P.median_split(panel(spark, sf))


# ---- quality --------------------------------------------------------------------------------


@check("a15_panel_summary", """
SELECT test_id, count(*) AS n_rows, count(DISTINCT geo) AS n_geos, count(DISTINCT date) AS n_dates, round(avg(revenue), 3) AS mean,
       round(median(revenue), 3) AS median, round(stddev_samp(revenue), 3) AS sd FROM x_panel GROUP BY 1
""")
def a15(spark, sf):
    return rounded(Q.panel_summary(panel(spark, sf)), 3)


view("x_missing", """
SELECT test_id, a.geo, a.cell, coalesce(n_obs, 0) AS n_obs, 1.0 - coalesce(n_obs, 0) / n_dates AS missing_share,
       1.0 - coalesce(n_obs, 0) / n_dates > 0.10 AS is_missing
FROM x_assign a JOIN (SELECT test_id, count(DISTINCT date) AS n_dates FROM x_panel GROUP BY 1) USING (test_id)
LEFT JOIN (SELECT test_id, geo, count(*) AS n_obs FROM x_panel GROUP BY 1, 2) USING (test_id, geo)
""")


@check("q05_missing_days", "SELECT test_id, geo, cell, n_obs, round(missing_share, 6) AS missing_share, is_missing FROM x_missing")
def q05(spark, sf):
    return rounded(Q.missing_days(panel(spark, sf), assignment(spark, sf)))


view("x_outliers", """
SELECT test_id, geo, date, (revenue - m) / sd AS z FROM (
  SELECT *, avg(revenue) OVER w AS m, stddev_samp(revenue) OVER w AS sd, count(*) OVER w AS n FROM x_panel
  WINDOW w AS (PARTITION BY test_id, geo)) WHERE n >= 7 AND sd >= 0.00000001 AND abs((revenue - m) / sd) > {t}
""".replace("{t}", "2.5"))


@check("w02_zscore_outliers", "SELECT test_id, geo, date, round(z, 6) AS z FROM x_outliers")
def w02(spark, sf):
    return rounded(Q.zscore_outliers(panel(spark, sf), 2.5).select("test_id", "geo", "date", "z"))


view("x_moves", """
SELECT test_id, geo, abs(revenue - lag(revenue) OVER (PARTITION BY test_id, geo ORDER BY date)) AS move FROM x_panel
""")
view("x_spikes", """
SELECT test_id, geo, count(*) FILTER (move > 3.0 * base) AS n_spikes FROM x_moves JOIN (
  SELECT test_id, geo, CASE WHEN median(move) >= 0.00000001 THEN median(move) WHEN avg(move) >= 0.00000001 THEN avg(move) END AS base
  FROM x_moves GROUP BY 1, 2 HAVING count(*) >= 7) USING (test_id, geo) WHERE base IS NOT NULL GROUP BY 1, 2
""")


@check("w01_spikes", "SELECT test_id, geo, n_spikes FROM x_spikes")
def w01(spark, sf):
    return Q.spike_counts(panel(spark, sf))


view("x_zeroed", "SELECT *, CASE WHEN orders <= 2 THEN 0 ELSE revenue END AS rev0 FROM x_panel")
view("x_zero_days", """
SELECT test_id, geo, avg(CASE WHEN rev0 <= 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM x_zeroed GROUP BY 1, 2
""")


def zeroed(spark, sf):
    return panel(spark, sf).withColumn("revenue", F.when(F.col("orders") <= 2, 0.0).otherwise(F.col("revenue")))


@check("q06_zero_days", "SELECT test_id, geo, round(zero_share, 6) AS zero_share, zero_share > 0.2 AS is_zero FROM x_zero_days")
def q06(spark, sf):
    return rounded(Q.zero_days(zeroed(spark, sf)))


def _alerts(df):
    return df.select("test_id", "severity", "category", F.array_join("affected_geos", ",").alias("geos"))


view("x_post_holdout", "SELECT test_id, count(DISTINCT geo) AS n FROM x_panel WHERE cell = 'holdout' AND period = 'post' GROUP BY 1")


@check("q07_coverage_alerts", """
SELECT test_id, 'blocker' AS severity, 'coverage' AS category, coalesce(string_agg(geo, ',' ORDER BY geo) FILTER (cell = 'holdout' AND NOT EXISTS (
    SELECT 1 FROM x_panel p WHERE p.test_id = a.test_id AND p.geo = a.geo AND p.period = 'post')), '') AS geos
FROM x_assign_plus a WHERE test_id NOT IN (SELECT test_id FROM x_post_holdout WHERE n >= 3) GROUP BY 1
UNION ALL SELECT test_id, 'warning', 'coverage', '' FROM x_post_holdout WHERE n >= 3 AND test_id IN (
  SELECT a.test_id FROM x_assign_plus a, (VALUES ('pre'), ('post')) v(period)
  WHERE NOT EXISTS (SELECT 1 FROM x_panel p WHERE p.test_id = a.test_id AND p.geo = a.geo AND p.period = v.period))
UNION ALL SELECT t.test_id, 'warning', 'coverage', '' FROM (SELECT DISTINCT test_id FROM x_assign_plus) t, (VALUES ('pre', 14), ('post', 7)) v(period, least_)
  WHERE (SELECT count(DISTINCT date) FROM x_panel p WHERE p.test_id = t.test_id AND p.period = v.period) < least_
""")
def q07(spark, sf):
    return _alerts(Q.coverage_alerts(panel(spark, sf), assignment_plus(spark, sf)))


@check("q08_anomaly_report", """
SELECT test_id, CASE WHEN count(*) FILTER (is_missing) > count(*) * 0.5 THEN 'blocker' ELSE 'warning' END AS severity, 'missing_data' AS category,
       coalesce(string_agg(geo, ',' ORDER BY geo) FILTER (is_missing), '') AS geos FROM x_missing GROUP BY 1 HAVING bool_or(is_missing)
UNION ALL SELECT test_id, 'warning', 'outlier', string_agg(DISTINCT geo, ',' ORDER BY geo) FROM (
  SELECT test_id, geo, (revenue - m) / sd AS z, n, sd FROM (SELECT *, avg(revenue) OVER w AS m, stddev_samp(revenue) OVER w AS sd, count(*) OVER w AS n
  FROM x_panel WINDOW w AS (PARTITION BY test_id, geo))) WHERE n >= 7 AND abs(z) > 3.5 GROUP BY 1
UNION ALL SELECT test_id, 'warning', 'spike', coalesce(string_agg(geo, ',' ORDER BY geo) FILTER (n_spikes > 0), '') FROM x_spikes
  GROUP BY 1 HAVING sum(n_spikes) > 2 * (SELECT count(DISTINCT geo) FROM x_geos)
UNION ALL SELECT test_id, 'warning', 'zero_revenue', string_agg(geo, ',' ORDER BY geo) FROM (
  SELECT test_id, geo FROM x_panel GROUP BY 1, 2 HAVING avg(CASE WHEN revenue <= 0 THEN 1.0 ELSE 0.0 END) > 0.2) GROUP BY 1
UNION ALL SELECT DISTINCT test_id, 'blocker', 'coverage', string_agg(geo, ',' ORDER BY geo) FROM x_assign a
  WHERE cell = 'holdout' AND NOT EXISTS (SELECT 1 FROM x_panel p WHERE p.test_id = a.test_id AND p.geo = a.geo AND p.period = 'post')
  AND test_id IN (SELECT test_id FROM x_post_holdout WHERE n < 3) GROUP BY test_id
UNION ALL SELECT test_id, 'warning', 'coverage', '' FROM x_post_holdout WHERE n >= 3 AND test_id IN (
  SELECT a.test_id FROM x_assign a, (VALUES ('pre'), ('post')) v(period)
  WHERE NOT EXISTS (SELECT 1 FROM x_panel p WHERE p.test_id = a.test_id AND p.geo = a.geo AND p.period = v.period))
UNION ALL SELECT test_id, 'warning', 'coverage', '' FROM (SELECT test_id, period, count(DISTINCT date) AS n FROM x_panel GROUP BY 1, 2)
  WHERE (period = 'pre' AND n < 14) OR (period = 'post' AND n < 7)
UNION ALL SELECT 't0', 'blocker', 'coverage', '' FROM (SELECT count(*) FROM nation)
""")
def q08(spark, sf):
    extra = assignment(spark, sf).filter("test_id = 't1'").withColumn("test_id", F.lit("t0"))
    return _alerts(Q.anomaly_report(panel(spark, sf), assignment(spark, sf).unionByName(extra)))


# ---- winsorising ----------------------------------------------------------------------------

view("x_geo_means", "SELECT test_id, period, geo, avg(revenue) AS m FROM x_wpanel GROUP BY 1, 2, 3")
view("x_cuts", """
SELECT test_id, period, quantile_cont(m, 0.1) AS low, quantile_cont(m, 0.9) AS high, count(*) AS n_geos FROM x_geo_means GROUP BY 1, 2
""")
view("x_winsor", """
SELECT p.test_id, p.period, p.geo, p.cell, p.date, p.revenue * CASE WHEN n_geos >= 5 AND m > 0 THEN least(greatest(least(greatest(m, low), high) / m, 0.1), 10.0) ELSE 1 END AS revenue
FROM x_wpanel p JOIN x_geo_means USING (test_id, period, geo) JOIN x_cuts USING (test_id, period)
""")


@check("f16_winsor_cutoffs", "SELECT test_id, period, round(low, 3) AS low, round(high, 3) AS high, n_geos FROM x_cuts")
def f16(spark, sf):
    means = panel(spark, sf, "weekly").groupBy("test_id", "period", "geo").agg(F.avg("revenue").alias("m"))
    return rounded(Q.winsor_cutoffs(means, ["test_id", "period"], "m", 0.1, 0.9), 3)


@check("q09_winsorised_panel", "SELECT test_id, period, geo, date, round(revenue, 3) AS revenue FROM x_winsor")
def q09(spark, sf):
    w = Q.winsorise(panel(spark, sf, "weekly"), low=0.1, high=0.9)
    return rounded(w.select("test_id", "period", "geo", "date", "revenue"), 3)
