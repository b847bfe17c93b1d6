"""Twins of the synthetic control: weights by pairwise steps, ridge by a whole inverse, all in recursive SQL."""

from __future__ import annotations

from parity.common import h, phi, view

T = "'*treatment*'"


def sc_views(tag: str, src: str, value: str = "revenue") -> None:
    """CTEs x_scw_<tag> (weights), x_scf_<tag> (fitted series), x_scr_<tag> (result rows) and x_scp_<tag> (placebo effects)."""
    view(f"x_scu_{tag}", f"""
    SELECT test_id, {T} AS unit, period, date, avg({value}) AS y FROM {src} WHERE cell = 'treatment' GROUP BY ALL
    UNION ALL SELECT test_id, geo, period, date, avg({value}) FROM {src} JOIN (
      SELECT test_id, geo FROM {src} WHERE cell = 'holdout' GROUP BY 1, 2 HAVING count(DISTINCT period) = 2) USING (test_id, geo) WHERE cell = 'holdout' GROUP BY ALL""")
    view(f"x_scd_{tag}", f"SELECT test_id, period, date, count(*) AS n FROM x_scu_{tag} WHERE unit <> {T} AND y IS NOT NULL GROUP BY ALL")
    view(f"x_sc_{tag}", f"""
    SELECT test_id, unit, period, date, y, y IS NOT NULL AND n - CASE WHEN unit = {T} THEN 0 ELSE 1 END >= 1 AS seen,
           coalesce(last_value(y IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(y IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS z
    FROM (SELECT DISTINCT test_id, unit, period FROM x_scu_{tag}) JOIN x_scd_{tag} USING (test_id, period) LEFT JOIN x_scu_{tag} USING (test_id, unit, period, date)
    WINDOW w AS (PARTITION BY test_id, unit, period ORDER BY date)""", stored=True)
    view(f"x_sct_{tag}", f"""
    SELECT test_id, unit AS target FROM x_sc_{tag} JOIN (SELECT test_id, count(DISTINCT unit) FILTER (unit <> {T}) AS donors FROM x_sc_{tag} GROUP BY 1) USING (test_id)
    GROUP BY test_id, unit, donors HAVING count(*) FILTER (seen AND period = 'pre') >= 7 AND count(*) FILTER (seen AND period = 'post') >= 3
       AND donors - CASE WHEN unit = {T} THEN 0 ELSE 1 END >= CASE WHEN unit = {T} THEN 1 ELSE 3 END""")
    # target and donor on each date of the target, the donor's pre mean taken off
    view(f"x_scx_{tag}", f"""
    SELECT c.test_id, c.unit AS target, d.unit AS donor, c.period, c.date, c.z AS y, d.z AS x, d.z - avg(d.z) FILTER (c.period = 'pre') OVER (PARTITION BY c.test_id, c.unit, d.unit) AS xc
    FROM x_sc_{tag} c JOIN x_sct_{tag} t ON t.test_id = c.test_id AND t.target = c.unit
    JOIN x_sc_{tag} d ON d.test_id = c.test_id AND d.date = c.date AND d.period = c.period AND d.unit <> c.unit AND d.unit <> {T} WHERE c.seen""", stored=True)
    view(f"x_sca_{tag}", f"""
    SELECT test_id, target, list(gaps ORDER BY donor) AS a, list(products ORDER BY donor) AS c, list(donor ORDER BY donor) AS donors FROM (
      SELECT test_id, target, donor, list(g ORDER BY other) AS gaps, list(p ORDER BY other) AS products FROM (
        SELECT a.test_id, a.target, a.donor, b.donor AS other, sum((a.x - a.y) * (b.x - b.y)) AS g, sum(a.xc * b.xc) AS p
        FROM x_scx_{tag} a JOIN x_scx_{tag} b USING (test_id, target, date) WHERE a.period = 'pre' AND b.period = 'pre' GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""", stored=True)
    # weight moves from the donor of the steepest slope to that of the least one, as far as it lowers the loss
    view(f"x_scs_{tag}", f"""
    SELECT test_id, target, 0 AS it, list_transform(a, lambda r: 1.0 / len(a)) AS w, list_transform(a, lambda r: list_sum(r) / len(a)) AS g FROM x_sca_{tag}
    UNION ALL
    SELECT test_id, target, it + 1, list_transform(w, lambda x, k: x + CASE k WHEN i THEN t WHEN j THEN -t ELSE 0.0 END), list_transform(g, lambda x, k: x + t * (a[k][i] - a[k][j])) FROM (
      SELECT *, least((g[j] - g[i]) / greatest(a[i][i] + a[j][j] - 2 * a[i][j], 1e-300), w[j]) AS t FROM (
        SELECT *, list_position(g, list_min(g)) AS i, list_position(steep, list_max(steep)) AS j FROM (
          SELECT s.*, a, list_transform(g, lambda x, k: CASE WHEN w[k] > 0 THEN x ELSE -1e300 END) AS steep FROM x_scs_{tag} s JOIN x_sca_{tag} USING (test_id, target)
          WHERE it < 3000 AND list_dot_product(w, g) - list_min(g) > 1e-12 * list_dot_product(w, g))))""", stored=True)
    view(f"x_scw_{tag}", f"""
    SELECT test_id, target, donors, w, list_dot_product(w, g) AS loss FROM (SELECT test_id, target, arg_max(w, it) AS w, arg_max(g, it) AS g FROM x_scs_{tag} GROUP BY 1, 2) JOIN x_sca_{tag} USING (test_id, target)""", stored=True)
    # inverse of the penalised products by elimination
    view(f"x_sci_{tag}", f"""
    SELECT test_id, target, alpha, 1 AS k, list_transform(c, lambda r, i: list_concat(list_transform(r, lambda x, j: x + CASE WHEN i = j THEN alpha ELSE 0.0 END), list_transform(r, lambda x, j: CASE WHEN i = j THEN 1.0 ELSE 0.0 END))) AS m
    FROM x_sca_{tag}, (SELECT pow(10.0, -2 + 6.0 * i / 19) AS alpha FROM range(20) g(i) UNION ALL SELECT 1.0)
    UNION ALL
    SELECT test_id, target, alpha, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END)
    FROM x_sci_{tag} WHERE k <= len(m)""", stored=True)
    view(f"x_scm_{tag}", f"SELECT test_id, target, alpha, list_transform(m, lambda r: r[len(m) + 1:]) AS m FROM x_sci_{tag} WHERE k = len(m) + 1")
    view(f"x_scl_{tag}", f"""
    SELECT *, avg(y) FILTER (period = 'pre') OVER p AS ym, avg(y - scm) FILTER (period = 'pre') OVER p AS rm, count(*) FILTER (period = 'pre') OVER p AS n FROM (
      SELECT l.*, list_dot_product(x, w) AS scm FROM (
        SELECT test_id, target, period, date, any_value(y) AS y, list(x ORDER BY donor) AS x, list(xc ORDER BY donor) AS xc FROM x_scx_{tag} GROUP BY ALL) l JOIN x_scw_{tag} USING (test_id, target))
    WINDOW p AS (PARTITION BY test_id, target)""", stored=True)
    view(f"x_scb_{tag}", f"""
    SELECT test_id, target, list(cy ORDER BY j) AS cy, list(cr ORDER BY j) AS cr FROM (
      SELECT test_id, target, j, sum(v * (y - ym)) AS cy, sum(v * (y - scm - rm)) AS cr FROM (
        SELECT test_id, target, y, ym, scm, rm, unnest(xc) AS v, unnest(range(len(xc))) AS j FROM x_scl_{tag} WHERE period = 'pre') GROUP BY ALL) GROUP BY ALL""")
    view(f"x_sce_{tag}", f"""
    SELECT test_id, target, arg_min(alpha, mse) AS alpha FROM (
      SELECT test_id, target, alpha, avg(pow((y - ym - list_dot_product(xc, list_transform(m, lambda r: list_dot_product(r, cy)))) / greatest(1 - 1.0 / n - list_dot_product(xc, list_transform(m, lambda r: list_dot_product(r, xc))), 1e-12), 2)) AS mse
      FROM x_scl_{tag} JOIN x_scm_{tag} USING (test_id, target) JOIN x_scb_{tag} USING (test_id, target) WHERE period = 'pre' AND alpha <> 1 GROUP BY ALL) GROUP BY ALL""")
    view(f"x_scf_{tag}", f"""
    SELECT test_id, target, penalty, alpha, period, date, y, synthetic, y - synthetic AS gap FROM (
      SELECT test_id, target, penalty, alpha, period, date, y, scm + rm + list_dot_product(xc, list_transform(m, lambda r: list_dot_product(r, cr))) AS synthetic
      FROM x_scl_{tag} JOIN (SELECT *, 'cv' AS penalty FROM x_sce_{tag} UNION ALL SELECT test_id, target, 1.0, 'fixed' FROM x_sct_{tag}) USING (test_id, target)
      JOIN x_scm_{tag} USING (test_id, target, alpha) JOIN x_scb_{tag} USING (test_id, target))""", stored=True)
    view(f"x_scp_{tag}", f"SELECT test_id, target, avg(gap) AS effect FROM x_scf_{tag} WHERE penalty = 'fixed' AND target <> {T} AND period = 'post' GROUP BY 1, 2")
    fit_views(tag, f"x_scf_{tag} WHERE penalty = 'cv'")
    view(f"x_scr_{tag}", f"""
    SELECT test_id, target, 'ascm' AS method, tau AS absolute_lift, {over('tau')} AS relative_lift, {over('lo')} AS lift_lower_ci, {over('hi')} AS lift_upper_ci, se, p AS p_value, p < 0.05 AS is_significant,
           CASE WHEN sd > 0 THEN tau / sd ELSE 0 END AS cohen_d, CASE WHEN se > 0 THEN {phi('tau / se')} ELSE 0.5 END AS lift_likelihood, l2_imbalance, r_squared, base AS baseline, n_placebos
    FROM (SELECT *, greatest(p0, coalesce(greatest(hits / nullif(n_placebos, 0), 1.0 / (n_placebos + 1)), 0)) AS p FROM (
      SELECT f.*, c.* EXCLUDE (test_id, target), (SELECT count(*) FROM x_scp_{tag} q WHERE q.test_id = f.test_id AND q.target <> f.target) AS n_placebos,
             (SELECT count(*) FROM x_scp_{tag} q WHERE q.test_id = f.test_id AND q.target <> f.target AND abs(q.effect) >= abs(f.tau)) AS hits
      FROM x_fit_{tag} f JOIN x_con_{tag} c USING (test_id, target)))""", stored=True)


def over(x: str) -> str:
    return f"CASE WHEN base > 0 THEN {x} / base ELSE 0 END"


def fit_views(tag: str, rows: str) -> None:
    """CTEs x_fit_<tag> (effect and fit of each target) and x_con_<tag> (permutation inference) of fitted series."""
    view(f"x_fit_{tag}", f"""
    SELECT test_id, target, tau, base, sd, sqrt(mse) / level AS l2_imbalance, CASE WHEN v > 0 THEN 1 - mse / v ELSE 0 END AS r_squared FROM (
      SELECT test_id, target, avg(gap) FILTER (period = 'post') AS tau, avg(synthetic) FILTER (period = 'post') AS base, stddev_samp(y) FILTER (period = 'post') AS sd,
             avg(gap * gap) FILTER (period = 'pre') AS mse, avg(abs(y)) FILTER (period = 'pre') AS level, var_pop(y) FILTER (period = 'pre') AS v FROM {rows} GROUP BY 1, 2)""")
    view(f"x_prm_{tag}", f"""
    SELECT test_id, target, rep, avg(gap) AS stat FROM (
      SELECT g.test_id, g.target, b.rep, g.gap, count(*) FILTER (period = 'post') OVER (PARTITION BY g.test_id, g.target, b.rep) AS n_post,
             row_number() OVER (PARTITION BY g.test_id, g.target, b.rep ORDER BY {h('g.test_id', 'g.target', 'b.rep', 'g.date')}, g.date) AS rk
      FROM (SELECT * FROM {rows}) g, range(2000) b(rep)) WHERE rk <= n_post GROUP BY 1, 2, 3""")
    view(f"x_con_{tag}", f"""
    SELECT test_id, target, (count(*) FILTER (abs(stat) >= abs(tau)) + 1) / 2001.0 AS p0, stddev_pop(stat) AS se,
           least(any_value(tau) - (quantile_cont(stat, 0.975) - avg(stat)), any_value(tau) - (quantile_cont(stat, 0.025) - avg(stat))) AS lo,
           greatest(any_value(tau) - (quantile_cont(stat, 0.975) - avg(stat)), any_value(tau) - (quantile_cont(stat, 0.025) - avg(stat))) AS hi
    FROM x_prm_{tag} JOIN x_fit_{tag} USING (test_id, target) GROUP BY 1, 2""")


sc_views("w", "x_wpanel")


# ---- structural series -----------------------------------------------------------------------

view("x_corr", """
SELECT test_id, unit, CASE WHEN stddev_pop(t) > 0 AND stddev_pop(y) > 0 THEN abs(covar_pop(t, y) / (stddev_pop(t) * stddev_pop(y))) ELSE 0 END AS abs_corr
FROM (SELECT test_id, date, y AS t FROM x_aligned WHERE period = 'pre' AND unit = '*treatment*') JOIN (SELECT test_id, date, unit, y FROM x_aligned WHERE period = 'pre' AND unit <> '*treatment*') USING (test_id, date) GROUP BY 1, 2
""")
view("x_corr_ranked", "SELECT *, CAST(row_number() OVER (PARTITION BY test_id ORDER BY abs_corr DESC, unit) AS INTEGER) AS rank, count(*) FILTER (abs_corr > 0.3) OVER (PARTITION BY test_id) AS good FROM x_corr")

# the filter of all variance ratios by recursion over the dates

view("x_bsx", """
SELECT test_id, unit, y, row_number() OVER (PARTITION BY test_id, unit ORDER BY period DESC, date) AS i, period, date,
       avg(y) FILTER (period = 'pre') OVER (PARTITION BY test_id, unit) AS m, greatest(stddev_pop(y) FILTER (period = 'pre') OVER (PARTITION BY test_id, unit), 1e-9) AS s
FROM x_aligned a WHERE unit = '*treatment*' OR EXISTS (
  SELECT 1 FROM x_corr_ranked c WHERE c.test_id = a.test_id AND c.unit = a.unit AND CASE WHEN good > 0 THEN abs_corr > 0.3 AND rank <= 10 ELSE rank <= 3 END)
""")
view("x_bsl", """
SELECT * FROM (
  SELECT t.test_id, t.i, t.period, t.date, t.y AS own, t.m, t.s, (t.y - t.m) / t.s AS y, list_concat([1.0, 0.0], coalesce(x, [])) AS load, len(coalesce(x, [])) AS n_x,
         count(*) FILTER (t.period = 'pre') OVER (PARTITION BY t.test_id) AS n_pre, count(*) OVER (PARTITION BY t.test_id) AS n
  FROM x_bsx t LEFT JOIN (SELECT test_id, i, list((y - m) / s ORDER BY unit) AS x FROM x_bsx WHERE unit <> '*treatment*' GROUP BY 1, 2) USING (test_id, i) WHERE t.unit = '*treatment*')
WHERE n_pre >= greatest(14, n_x + 4) AND n > n_pre
""", stored=True)
view("x_bsk", """
SELECT test_id, q, r, 0 AS i, list_transform(load, lambda x: 0.0) AS s, list_transform(load, lambda x, a: list_transform(load, lambda z, b: CASE WHEN a = b THEN 1e7 ELSE 0.0 END)) AS p,
       0.0 AS mean, 0.0 AS var, 0.0 AS logs, 0.0 AS squares
FROM x_bsl, (SELECT unnest([0.0, 0.001, 0.01, 0.1, 1.0]) AS q), (SELECT unnest([0.0, 0.00001, 0.0001, 0.001, 0.01]) AS r) WHERE i = 1
UNION ALL
SELECT test_id, q, r, i, list_transform(s, lambda x, a: x + CASE WHEN a = 1 THEN s[2] ELSE 0.0 END),
       list_transform(p, lambda v, a: list_transform(v, lambda x, b: x + CASE WHEN a = 1 THEN p[2][b] ELSE 0.0 END + CASE WHEN b = 1 THEN v[2] ELSE 0.0 END
         + CASE WHEN a = 1 AND b = 1 THEN p[2][2] + q WHEN a = 2 AND b = 2 THEN r ELSE 0.0 END)), mean, var, logs, squares
FROM (
  SELECT test_id, q, r, i, mean, var, logs + CASE WHEN i <= n_pre AND i > 2 + n_x THEN ln(var) ELSE 0.0 END AS logs, squares + CASE WHEN i <= n_pre AND i > 2 + n_x THEN pow(y - mean, 2) / var ELSE 0.0 END AS squares,
         list_transform(s, lambda x, a: x + CASE WHEN i <= n_pre THEN g[a] / var * (y - mean) ELSE 0.0 END) AS s,
         list_transform(p, lambda v, a: list_transform(v, lambda x, b: x - CASE WHEN i <= n_pre THEN g[a] / var * g[b] ELSE 0.0 END)) AS p
  FROM (SELECT *, list_dot_product(load, s) AS mean, list_dot_product(load, g) + 1 AS var FROM (
    SELECT k.test_id, k.q, k.r, l.i, l.n_pre, l.n_x, l.load, l.y, k.s, k.p, k.logs, k.squares, list_transform(k.p, lambda v: list_dot_product(v, l.load)) AS g
    FROM x_bsk k JOIN x_bsl l ON l.test_id = k.test_id AND l.i = k.i + 1)))
""", stored=True)
view("x_bsf", """
SELECT l.test_id, '*treatment*' AS target, l.period, l.date, l.own AS y, k.mean * l.s + l.m AS synthetic, l.own - (k.mean * l.s + l.m) AS gap, sqrt(k.var * f.sigma2) * l.s AS se
FROM x_bsl l JOIN x_bsk k USING (test_id, i) JOIN (
  SELECT test_id, arg_max({'q': q, 'r': r, 'v': sigma2}, like_) AS best FROM (
    SELECT test_id, q, r, squares / greatest(n_pre - 2 - n_x, 1) AS sigma2, -0.5 * ((n_pre - 2 - n_x) * ln(greatest(squares / greatest(n_pre - 2 - n_x, 1), 1e-300)) + logs) AS like_
    FROM x_bsk JOIN x_bsl USING (test_id, i) WHERE i = n) GROUP BY 1) b USING (test_id), LATERAL (SELECT b.best.v AS sigma2) f
WHERE k.q = b.best.q AND k.r = b.best.r AND NOT (l.period = 'pre' AND l.i <= 2 + l.n_x)
""", stored=True)
fit_views("bs", "x_bsf")
view("x_bsr", f"""
SELECT test_id, 'bsts' AS method, tau AS absolute_lift, {over('tau')} AS relative_lift, {over('(tau - 1.959963984540054 * se)')} AS lift_lower_ci, {over('(tau + 1.959963984540054 * se)')} AS lift_upper_ci,
       se, 2 * least(up, 1 - up) AS p_value, 2 * least(up, 1 - up) < 0.05 AS is_significant, CASE WHEN sd > 0 THEN tau / sd ELSE 0 END AS cohen_d, up AS lift_likelihood, l2_imbalance, r_squared
FROM (SELECT *, CASE WHEN se > 0 THEN {phi('tau / se')} ELSE 0.5 END AS up FROM x_fit_bs JOIN (
  SELECT test_id, sqrt(sum(se * se)) / count(*) AS se FROM x_bsf WHERE period = 'post' GROUP BY 1) USING (test_id))
""", stored=True)
view("x_estimates", """
SELECT test_id, method, absolute_lift, relative_lift, lift_lower_ci, lift_upper_ci, se, p_value, is_significant, cohen_d, lift_likelihood, l2_imbalance, r_squared FROM x_scr_w WHERE target = '*treatment*'
UNION ALL SELECT test_id, method, absolute_lift, relative_lift, lift_lower_ci, lift_upper_ci, se, p_value, is_significant, cohen_d, lift_likelihood, l2_imbalance, r_squared FROM x_bsr
UNION ALL SELECT test_id, method, absolute_lift, relative_lift, lift_lower_ci, lift_upper_ci, se, p_value, p_value < 0.05, cohen_d, lift_likelihood, 0, 0 FROM x_did_w
""", stored=True)

# ---- halves of the pre period ----------------------------------------------------------------

view("x_halves", """
SELECT p.test_id, geo, cell, p.date, revenue, CASE WHEN p.date < split_date THEN 'pre' ELSE 'post' END AS period FROM x_wpanel p JOIN (
  SELECT test_id, date AS split_date FROM (
    SELECT test_id, date, row_number() OVER (PARTITION BY test_id ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY test_id) AS n
    FROM (SELECT DISTINCT test_id, date FROM x_wpanel WHERE period = 'pre')) WHERE n >= 14 AND idx = n // 2) USING (test_id) WHERE period = 'pre'
""", stored=True)
sc_views("h", "x_halves")
