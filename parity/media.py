"""Media-mix inputs, effects and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from liftfield.operators import budget as B
from liftfield.operators import media as M
from parity.common import check, daily, geos, h, market_daily, population, rounded, spend_daily, spend_events, table, view
from parity.response import share

CHANNELS = ["click", "view", "purchase", "signup", "error"]
DISCOUNTS = {"click": 0.9, "view": 0.6, "signup": 0.75}
EXTRA = "SELECT geo FROM x_geos UNION ALL SELECT 'nowhere'"


def all_markets(spark, sf):
    """The market list plus one that never appears."""
    return geos(spark, sf).select("geo").unionByName(spark.range(1).select(F.lit("nowhere").alias("geo")))


# ---- panels ---------------------------------------------------------------------------------

view("x_kpi", f"""
SELECT d.date, g.geo, CASE WHEN s.revenue IS NOT NULL THEN s.revenue WHEN g.geo NOT IN (SELECT geo FROM x_daily) THEN 0 END AS store,
       CASE WHEN m.revenue IS NOT NULL THEN m.revenue WHEN g.geo NOT IN (SELECT geo FROM x_market_daily) THEN 0 END AS marketplace
FROM (SELECT DISTINCT date FROM x_daily INTERSECT SELECT DISTINCT date FROM x_market_daily) d, ({EXTRA}) g
LEFT JOIN x_daily s ON s.date = d.date AND s.geo = g.geo LEFT JOIN x_market_daily m ON m.date = d.date AND m.geo = g.geo
""")


def kpi(spark, sf):
    return M.kpi_panel({"store": daily(spark, sf), "marketplace": market_daily(spark, sf)}, all_markets(spark, sf))


@check("q02_kpi_panel", "SELECT date, geo, round(store, 2) AS store, round(marketplace, 4) AS marketplace FROM x_kpi")
def q02(spark, sf):
    return rounded(kpi(spark, sf), 4, store=2)


# one channel stops early and one market has no spend on it, so that all three gap rules apply
view("x_media_src", """
SELECT * FROM x_spend WHERE NOT (channel = 'view' AND date > DATE '2001-07-20') AND NOT (channel = 'signup' AND geo = '3')
""")
_DISC = "CASE channel " + " ".join(f"WHEN '{c}' THEN {d}" for c, d in DISCOUNTS.items()) + " ELSE 1.0 END"
view("x_media", f"""
SELECT date, geo, channel, v AS spend, v * {_DISC} AS discounted_spend FROM (
  SELECT d.date, g.geo, c.channel, CASE WHEN s.spend IS NOT NULL THEN s.spend
    WHEN (c.channel, g.geo) NOT IN (SELECT DISTINCT channel, geo FROM x_media_src) OR (c.channel, d.date) NOT IN (SELECT DISTINCT channel, date FROM x_media_src) THEN 0 END AS v
  FROM (SELECT DISTINCT date FROM x_media_src WHERE channel = 'click') d, ({EXTRA}) g, (SELECT unnest({CHANNELS}) AS channel) c
  LEFT JOIN x_media_src s ON s.date = d.date AND s.geo = g.geo AND s.channel = c.channel)
""")


def media_source(spark, sf):
    s = spend_daily(spark, sf)
    return s.filter("NOT (channel = 'view' AND date > DATE'2001-07-20') AND NOT (channel = 'signup' AND geo = '3')")


def media(spark, sf):
    return M.media_panel(media_source(spark, sf), all_markets(spark, sf), CHANNELS, DISCOUNTS)


@check("q03_media_panel", "SELECT date, geo, channel, round(spend, 4) AS spend, round(discounted_spend, 4) AS discounted_spend FROM x_media")
def q03(spark, sf):
    return rounded(media(spark, sf), 4)


view("x_promo", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS depth, CAST(max(o_orderkey % 7) AS DOUBLE) AS idx FROM orders GROUP BY 1")
view("x_trends", "SELECT CAST(o_orderdate AS DATE) AS date, CAST(min(o_orderkey % 100) AS DOUBLE) AS idx FROM orders GROUP BY 1")
view("x_rank", "SELECT CAST(l_shipdate AS DATE) AS date, CAST(max(l_linenumber) AS DOUBLE) AS best_rank FROM lineitem GROUP BY 1")
view("x_features", """
SELECT date, CAST(coalesce(p.depth, 0) AS DOUBLE) AS depth, coalesce(p.idx, 0) AS idx, coalesce(t.idx, 0) AS idx_trends, coalesce(b.best_rank, 0) AS best_rank
FROM x_promo p FULL JOIN x_trends t USING (date) FULL JOIN x_rank b USING (date)
""")


def features(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    day = F.col("o_orderdate").cast("date").alias("date")
    return {
        "promo": o.groupBy(day).agg(F.count("*").alias("depth"), F.max(F.col("o_orderkey") % 7).cast("double").alias("idx")),
        "trends": o.groupBy(day).agg(F.min(F.col("o_orderkey") % 100).cast("double").alias("idx")),
        "rank": li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.max("l_linenumber").cast("double").alias("best_rank")),
    }


@check("j10_national_features", "SELECT * FROM x_features")
def j10(spark, sf):
    return M.national_features(features(spark, sf))


@check("a24_population_weights", "SELECT geo, round(population / sum(population) OVER (), 6) AS weight FROM x_population")
def a24(spark, sf):
    return rounded(M.population_weights(population(spark, sf)))


@check("q04_input_bundle", """
SELECT 'kpi' AS part, count(*) AS n_rows, round(sum(store), 2) AS total FROM x_kpi UNION ALL SELECT 'media', count(*), round(sum(spend), 2) FROM x_media
UNION ALL SELECT 'features', count(*), sum(coalesce(depth, 0)) FROM x_kpi LEFT JOIN x_features USING (date) UNION ALL SELECT 'population', count(*), 1.0 FROM x_population
""")
def q04(spark, sf):
    b = M.input_bundle(daily(spark, sf), market_daily(spark, sf), media_source(spark, sf), features(spark, sf), population(spark, sf),
                       all_markets(spark, sf), CHANNELS, DISCOUNTS)
    out = None
    for name, amount in (("kpi", "store"), ("media", "spend"), ("features", "depth"), ("population", "weight")):
        row = b[name].agg(F.lit(name).alias("part"), F.count("*").alias("n_rows"), F.round(F.sum(amount), 2).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- adstock and features -------------------------------------------------------------------


def lag_sum(x: str, weights: list[float]) -> str:
    return " + ".join(f"{w!r} * coalesce(lag({x}, {i}) OVER w, 0)" for i, w in enumerate(weights))


GEO_W = [0.6**i for i in range(5)]
WEI_W = M.weibull_weights(0.8, 2.0, 1.5, 4)


def spend_series(spark, sf):
    return media(spark, sf).select("date", "geo", "channel", F.coalesce("discounted_spend", F.lit(0.0)).alias("x"))


view("x_series", "SELECT date, geo, channel, coalesce(discounted_spend, 0) AS x FROM x_media")


@check("w05_geometric_adstock", f"SELECT date, geo, channel, round({lag_sum('x', GEO_W)}, 6) AS adstock FROM x_series WINDOW w AS (PARTITION BY geo, channel ORDER BY date)")
def w05(spark, sf):
    return rounded(M.geometric_adstock(spend_series(spark, sf), 0.6, 4, ["geo", "channel"]).drop("x"))


@check("w06_weibull_adstock", f"SELECT date, geo, channel, round(x + {lag_sum('x', WEI_W)}, 6) AS adstock FROM x_series WINDOW w AS (PARTITION BY geo, channel ORDER BY date)")
def w06(spark, sf):
    return rounded(M.weibull_adstock(spend_series(spark, sf), 0.8, 2.0, 1.5, 4, ["geo", "channel"]).drop("x"))


view("x_mfeat", f"""
SELECT date, geo, channel, adstock, {share('adstock', '1.2', '300.0')} AS feature FROM (
  SELECT date, geo, channel, {lag_sum('x', GEO_W)} AS adstock FROM x_series WINDOW w AS (PARTITION BY geo, channel ORDER BY date))
""")


def media_features(spark, sf):
    return M.media_features(media(spark, sf), 0.6, 4, 1.2, 300.0)


@check("m01_media_features", "SELECT date, geo, channel, round(adstock, 6) AS adstock, round(feature, 6) AS feature FROM x_mfeat")
def m01(spark, sf):
    return rounded(media_features(spark, sf))


# normal equations of each outcome and replicate, solved by elimination; a dropped channel's row is that of the unit matrix
N_BOOT = 200
_V = ["1.0", *(f"x{i}" for i in range(len(CHANNELS))), "lev", "sin(turn)", "cos(turn)", "y"]
_K = len(_V)
view("x_m2p", f"""
SELECT k.outcome, k.geo, k.y, 2 * pi() * dayofyear(k.date) / 365.25 AS turn, avg(k.y) OVER (PARTITION BY k.outcome, k.geo) AS lev, w.* EXCLUDE (date, geo), w.geo IS NOT NULL AS used
FROM (SELECT date, geo, 'store' AS outcome, coalesce(store, 0) AS y FROM x_kpi UNION ALL SELECT date, geo, 'marketplace', coalesce(marketplace, 0) FROM x_kpi) k
LEFT JOIN (SELECT date, geo, {", ".join(f"coalesce(max(feature) FILTER (channel = '{c}'), 0) AS x{i}" for i, c in enumerate(CHANNELS))} FROM x_mfeat GROUP BY 1, 2) w ON w.date = k.date AND w.geo = k.geo
""")
view("x_m2g", f"""
SELECT outcome, geo, population / (SELECT sum(population) FROM x_population) AS weight, {", ".join(f"sum(({_V[i]}) * ({_V[j]})) AS m_{i}_{j}" for i in range(_K) for j in range(i, _K))}
FROM x_m2p JOIN x_population USING (geo) WHERE used GROUP BY outcome, geo, population
""", stored=True)
view("x_m2t", f"""
SELECT DISTINCT 0 AS rep, geo, 1 AS times FROM x_m2g UNION ALL
SELECT rep, geo, count(*) FROM (SELECT b.rep, {h('b.rep', 's.slot')} % n AS pick FROM range(1, {N_BOOT + 1}) b(rep), (SELECT count(DISTINCT geo) AS n FROM x_m2g), range(100) s(slot) WHERE s.slot < n)
JOIN (SELECT geo, row_number() OVER (ORDER BY geo) - 1 AS pick FROM (SELECT DISTINCT geo FROM x_m2g)) USING (pick) GROUP BY 1, 2
""")
view("x_m2s", f"SELECT outcome, rep, {', '.join(f'sum(weight * times * m_{i}_{j}) AS m_{i}_{j}' for i in range(_K) for j in range(i, _K))} FROM x_m2g JOIN x_m2t USING (geo) GROUP BY 1, 2")
_m = lambda i, j: f"m_{min(i, j)}_{max(i, j)}"
_cov = lambda i, j: f"({_m(i, j)} / m_0_0 - {_m(0, i)} / m_0_0 * {_m(0, j)} / m_0_0)"
view("x_m2c", f"""
SELECT outcome, rep, sd[{_K - 1}] AS sd_y, sd[1:{_K - 2}] AS sd, [{", ".join("[" + ", ".join(f"{_cov(i, j)} / (sd[{i}] * sd[{j}])" + (f" + 0.1 / sd[{_K - 1}]" if i == j else "") for j in range(1, _K - 1)) + f", {_cov(i, _K - 1)} / (sd[{i}] * sd[{_K - 1}])]" for i in range(1, _K - 1))}] AS a
FROM (SELECT *, [{", ".join(f"sqrt({_cov(i, i)})" for i in range(1, _K))}] AS sd FROM x_m2s)
""", stored=True)
view("x_m2r", f"""
SELECT outcome, rep, 1 AS k, list_transform(range({_K - 2}), lambda i: true) AS used, a AS m FROM x_m2c
UNION ALL
SELECT outcome, rep, CASE WHEN k <= {_K - 2} THEN k + 1 ELSE 1 END, CASE WHEN k <= {_K - 2} THEN used ELSE list_transform(used, lambda u, i: u AND (i > {len(CHANNELS)} OR m[i][{_K - 1}] >= 0)) END,
       CASE WHEN k <= {_K - 2} THEN list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END)
       ELSE list_transform(a, lambda r, i: list_transform(r, lambda x, j: CASE WHEN NOT (used[i] AND (i > {len(CHANNELS)} OR m[i][{_K - 1}] >= 0)) THEN CASE WHEN i = j THEN 1.0 ELSE 0.0 END
         WHEN j < {_K - 1} AND NOT (used[j] AND (j > {len(CHANNELS)} OR m[j][{_K - 1}] >= 0)) THEN 0.0 ELSE x END)) END
FROM x_m2r JOIN x_m2c USING (outcome, rep) WHERE k <= {_K - 2} OR len(list_filter(m, lambda r, i: i <= {len(CHANNELS)} AND r[{_K - 1}] < 0)) > 0
""", stored=True)
view("x_m2e", f"""
SELECT outcome, CAST(rep AS INTEGER) AS replicate, {CHANNELS}[CAST(i AS INTEGER)] AS channel, CASE WHEN used[i] THEN m[i][{_K - 1}] * sd_y / sd[i] ELSE 0 END AS effect, used[i] AS is_kept
FROM x_m2r JOIN x_m2c USING (outcome, rep), range(1, {len(CHANNELS) + 1}) g(i) WHERE k = {_K - 1} AND len(list_filter(m, lambda r, i: i <= {len(CHANNELS)} AND r[{_K - 1}] < 0)) = 0
""")
OUTCOMES = ["store", "marketplace"]


@check("m02_channel_effects", "SELECT outcome, channel, round(effect, 4) AS effect, is_kept FROM x_m2e WHERE replicate = 0")
def m02(spark, sf):
    w = M.population_weights(population(spark, sf))
    return rounded(M.fit_channel_effects(media_features(spark, sf), kpi(spark, sf), OUTCOMES, CHANNELS, w), 4)


@check("m02_effect_draws", "SELECT outcome, replicate, channel, round(effect, 4) AS effect, is_kept FROM x_m2e")
def m02b(spark, sf):
    w = M.population_weights(population(spark, sf))
    return rounded(M.channel_effect_draws(media_features(spark, sf), kpi(spark, sf), OUTCOMES, CHANNELS, w, n_boot=N_BOOT), 4)


# effect draws: one per line item, channel by line number, outcome by return flag
_CH_SQL = f"{CHANNELS}[CAST(l_linenumber % 5 AS INTEGER) + 1]"
view("x_draws", f"""
SELECT {_CH_SQL} AS channel, CASE WHEN l_returnflag = 'R' THEN 'amazon' ELSE 'shopify' END AS outcome, l_orderkey % 4 AS chain,
       l_quantity * (1 + l_linenumber % 5) AS effect, CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem
""")


def draws(spark, sf):
    pick = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        pick.alias("channel"), F.when(F.col("l_returnflag") == "R", "amazon").otherwise("shopify").alias("outcome"),
        (F.col("l_orderkey") % 4).alias("chain"), (F.col("l_quantity") * (1 + F.col("l_linenumber") % 5)).alias("effect"),
        F.date_trunc("month", "l_shipdate").cast("date").alias("date"))


view("x_contrib", """
SELECT date, geo, channel, outcome, m * feature AS contribution_mean, p10 * feature AS contribution_p10, p90 * feature AS contribution_p90
FROM x_mfeat JOIN (SELECT channel, outcome, avg(effect) AS m, quantile_cont(effect, 0.1) AS p10, quantile_cont(effect, 0.9) AS p90 FROM x_draws GROUP BY 1, 2) USING (channel)
""")


def contributions(spark, sf):
    return M.contributions(media_features(spark, sf), draws(spark, sf))


@check("m03_contributions", "SELECT date, geo, channel, outcome, round(contribution_mean, 6) AS contribution_mean, round(contribution_p10, 6) AS contribution_p10, round(contribution_p90, 6) AS contribution_p90 FROM x_contrib")
def m03(spark, sf):
    return rounded(contributions(spark, sf))


view("x_pdraws", "SELECT 'beta_' || channel || CASE WHEN outcome = 'amazon' THEN '_amazon' ELSE '' END AS parameter, chain, effect + chain * 2 * length(channel) AS value, date FROM x_draws")
view("x_rhat", """
SELECT parameter, n_chains, CASE WHEN w > 0 THEN sqrt(((n - 1) / n * w + b) / w) ELSE 1 END AS rhat
FROM (SELECT parameter, avg(n) AS n, avg(v) AS w, var_samp(m) AS b, count(*) AS n_chains FROM (
  SELECT parameter, chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM x_pdraws GROUP BY 1, 2) GROUP BY 1)
""")


def parameter_draws(spark, sf):
    name = F.concat(F.lit("beta_"), F.col("channel"), F.when(F.col("outcome") == "amazon", "_amazon").otherwise(""))
    return draws(spark, sf).select(name.alias("parameter"), "chain", (F.col("effect") + F.col("chain") * 2 * F.length("channel")).alias("value"), "date", "channel")


def rhats(spark, sf):
    return M.rhat(parameter_draws(spark, sf))


@check("m04_rhat", "SELECT parameter, n_chains, round(rhat, 6) AS rhat, rhat > 1.05 AS is_high FROM x_rhat")
def m04(spark, sf):
    return rounded(rhats(spark, sf).drop("threshold"))


view("x_betas", "SELECT date, channel, avg(effect) AS beta_mean, quantile_cont(effect, 0.1) AS beta_p10, quantile_cont(effect, 0.9) AS beta_p90 FROM x_draws GROUP BY 1, 2")


def betas(spark, sf):
    return M.varying_betas(draws(spark, sf).select("date", "channel", F.col("effect").alias("value")))


@check("m05_varying_betas", "SELECT date, channel, round(beta_mean, 5) AS beta_mean, round(beta_p10, 5) AS beta_p10, round(beta_p90, 5) AS beta_p90 FROM x_betas")
def m05(spark, sf):
    return rounded(betas(spark, sf), 5)


# curves whose size follows each channel's spend
view("x_params", """
SELECT channel, o.outcome, total * o.f AS scale, o.a + (ascii(channel) % 3) * 0.2 AS alpha, total * (0.1 + (ascii(channel) % 5) * 0.05) AS gamma, total AS spend, total AS spend_max
FROM (SELECT channel, sum(spend) AS total FROM x_spend GROUP BY 1), (VALUES ('shopify', 4.0, 0.9), ('amazon', 1.5, 1.1)) o(outcome, f, a)
""")


def curve_params(spark, sf):
    total = spend_daily(spark, sf).groupBy("channel").agg(F.sum("spend").alias("total"))
    kinds = F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(f).alias("f"), F.lit(a).alias("a")) for o, f, a in (("shopify", 4.0, 0.9), ("amazon", 1.5, 1.1))])
    rows = total.withColumn("o", F.explode(kinds))
    c = F.ascii("channel")
    return rows.select(
        "channel", F.col("o.outcome").alias("outcome"), (F.col("total") * F.col("o.f")).alias("scale"), (F.col("o.a") + (c % 3) * 0.2).alias("alpha"),
        (F.col("total") * (0.1 + (c % 5) * 0.05)).alias("gamma"), F.col("total").alias("spend"), F.col("total").alias("spend_max"))


@check("m06_saturation_curves", f"""
SELECT channel, outcome, CAST(i AS INTEGER) AS point, round(s, 4) AS spend, round(scale * {share('s', 'alpha', 'gamma')}, 4) AS revenue
FROM (SELECT *, greatest(spend_max * 1.5, 1) * i / 99 AS s FROM x_params, range(100) g(i))
""")
def m06(spark, sf):
    return rounded(M.saturation_curves(curve_params(spark, sf)), 4)


# ---- budgets --------------------------------------------------------------------------------

BUDGETS = {"base": 60000.0, "small": 20000.0}
FLOORS = {"error": 3000.0, "view": 1500.0}
N = 1000


def _rev(x: str) -> str:
    return f"(0.7 * ss * {share(x, 'sa', 'sg')} + 0.3 * ms * {share(x, 'ma', 'mg')}) * sf"


view("x_wide", """
SELECT channel, max(scale) FILTER (outcome = 'shopify') AS ss, max(alpha) FILTER (outcome = 'shopify') AS sa, max(gamma) FILTER (outcome = 'shopify') AS sg,
       max(scale) FILTER (outcome = 'amazon') AS ms, max(alpha) FILTER (outcome = 'amazon') AS ma, max(gamma) FILTER (outcome = 'amazon') AS mg FROM x_params GROUP BY 1
""")


def allocation_view(name: str, scenarios: str, floors: dict[str, float]) -> None:
    """scenarios: a table (scenario, budget, sign) — sign shifts every scale by 20 %."""
    fl = "CASE channel " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in floors.items()) + " ELSE 0.0 END" if floors else "0.0"
    view(f"{name}_rows", f"""
    SELECT *, least({N}, floor((budget * 0.55 - fl) / step + 0.000000001)) AS n FROM (
      SELECT w.*, s.scenario, s.budget, 1 + s.sign * 0.2 AS sf, {fl} AS fl, (s.budget - {float(sum(floors.values()))}) / {N} AS step FROM x_wide w, {scenarios} s)""")
    view(f"{name}_pieces", f"""
    SELECT scenario, channel, j, {_rev('fl + (j + 1) * step')} - {_rev('fl + j * step')} AS gain, ({_rev('fl + (j + 1) * step')} - {_rev('fl + 0 * step')}) / (j + 1) AS mean_gain
    FROM {name}_rows, range({N}) g(j) WHERE j < n""")
    view(name, f"""
    SELECT r.scenario, r.channel, r.budget, r.ss, r.sa, r.sg, r.ms, r.ma, r.mg, r.sf, r.fl + coalesce(t.n, 0) * r.step AS spend FROM {name}_rows r LEFT JOIN (
      SELECT scenario, channel, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY priority DESC, channel, j) AS rk FROM (
        SELECT p.scenario, p.channel, p.j, min(CASE WHEN p.j <= k.j THEN k.mean_gain ELSE p.gain END) OVER (PARTITION BY p.scenario, p.channel ORDER BY p.j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS priority
        FROM {name}_pieces p JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, channel ORDER BY mean_gain DESC, j) AS o FROM {name}_pieces) WHERE o = 1) k USING (scenario, channel))) WHERE rk <= {N}
      GROUP BY 1, 2) t USING (scenario, channel)""")


allocation_view("x_alloc", "(SELECT * FROM (VALUES ('base', 60000.0, 0), ('small', 20000.0, 0)) v(scenario, budget, sign)) ", FLOORS)
allocation_view("x_bounds", "(SELECT * FROM (VALUES ('base', 60000.0, 0), ('low', 60000.0, -1), ('high', 60000.0, 1)) v(scenario, budget, sign)) ", {})


def allocation(spark, sf):
    return B.allocate(curve_params(spark, sf), BUDGETS, FLOORS)


@check("m07_allocation", "SELECT scenario, channel, round(spend, 4) AS spend FROM x_alloc")
def m07(spark, sf):
    return rounded(allocation(spark, sf).select("scenario", "channel", "spend"), 4)


view("x_alloc_sum", f"""
SELECT scenario, budget, sum(spend) AS total_spend, sum(ss * {share('spend', 'sa', 'sg')} * sf) AS shopify_revenue, sum(ms * {share('spend', 'ma', 'mg')} * sf) AS amazon_revenue FROM x_alloc GROUP BY 1, 2
""")


@check("m07_allocation_summary", """
SELECT scenario, budget, round(total_spend, 4) AS total_spend, round(shopify_revenue, 4) AS shopify_revenue, round(amazon_revenue, 4) AS amazon_revenue,
       round(0.7 * shopify_revenue + 0.3 * amazon_revenue, 4) AS blended_revenue, round((0.7 * shopify_revenue + 0.3 * amazon_revenue) / total_spend, 6) AS blended_roas FROM x_alloc_sum
""")
def m07b(spark, sf):
    return rounded(B.allocation_summary(allocation(spark, sf)), 4, blended_roas=6)


@check("m12_allocation_bounds", """
SELECT channel, round(max(spend) FILTER (scenario = 'base'), 4) AS spend, round(max(spend) FILTER (scenario = 'low'), 4) AS spend_lower,
       round(max(spend) FILTER (scenario = 'high'), 4) AS spend_upper FROM x_bounds GROUP BY 1
""")
def m12(spark, sf):
    return rounded(B.allocation_bounds(curve_params(spark, sf), 60000.0, {c: 0.2 for c in CHANNELS}), 4)


@check("m12_flat_bounds", """
SELECT channel, round(spend, 4) AS spend, round(spend * 0.85, 4) AS spend_lower, round(least(spend * 1.15, 60000), 4) AS spend_upper FROM x_bounds WHERE scenario = 'base'
""")
def m12b(spark, sf):
    return rounded(B.allocation_bounds(curve_params(spark, sf), 60000.0), 4)


view("x_ghill", """
SELECT channel, 1.0 + ascii(channel) % 4 AS alpha, total * 0.4 AS kappa, 0.6 + (ascii(channel) % 3) * 0.1 AS gamma FROM (SELECT channel, sum(spend) AS total FROM x_spend GROUP BY 1)
""")


def greedy_params(spark, sf):
    total = spend_daily(spark, sf).groupBy("channel").agg(F.sum("spend").alias("total"))
    c = F.ascii("channel")
    return total.select("channel", (1.0 + c % 4).alias("alpha"), (F.col("total") * 0.4).alias("kappa"), (0.6 + (c % 3) * 0.1).alias("gamma"))


def _groas(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN alpha * pow({x}, gamma) / (pow(kappa, gamma) + pow({x}, gamma)) * ({x}) ELSE 0 END)"


def greedy_view(name: str, scenarios: str, floors: dict[str, float], steps: int) -> None:
    fl = "CASE channel " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in floors.items()) + " ELSE 0.0 END"
    view(f"{name}_rows", f"""
    SELECT *, sum(start) OVER (PARTITION BY scenario) AS used, (budget - sum(start) OVER (PARTITION BY scenario)) / {steps} AS step FROM (
      SELECT g.*, s.scenario, s.budget, greatest({fl}, s.budget * 0.01) AS start FROM x_ghill g, {scenarios} s)""")
    view(name, f"""
    SELECT *, {_groas('spend')} AS revenue FROM (
      SELECT r.scenario, r.channel, r.budget, alpha, kappa, gamma, CASE WHEN step > 0 THEN start + coalesce(n, 0) * step ELSE start / used * budget END AS spend FROM {name}_rows r LEFT JOIN (
        SELECT scenario, channel, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY priority DESC, channel, j) AS rk FROM (
          SELECT scenario, channel, j, min(({_groas('(x + 500)')} - {_groas('x')}) / 500) OVER (PARTITION BY scenario, channel ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS priority
          FROM (SELECT *, start + j * step AS x FROM {name}_rows, range({steps}) g(j) WHERE step > 0))) WHERE rk <= {steps} GROUP BY 1, 2) t USING (scenario, channel))""")


greedy_view("x_greedy", "(SELECT * FROM (VALUES ('base', 60000.0), ('tight', 4000.0)) v(scenario, budget)) ", FLOORS, 1000)
greedy_view("x_sweep", "(SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS scenario, 60000.0 * (1 + (-0.30 + 0.02 * i)) AS budget FROM range(31) v(i)) ", FLOORS, 500)


@check("m08_greedy_allocation", "SELECT scenario, channel, budget, round(spend, 4) AS spend, round(revenue, 4) AS revenue FROM x_greedy")
def m08(spark, sf):
    g = B.greedy_allocation(greedy_params(spark, sf), {"base": 60000.0, "tight": 4000.0}, FLOORS)
    return rounded(g.select("scenario", "channel", "budget", "spend", "revenue"), 4)


@check("m09_scenario_sweep", """
SELECT scenario, round(budget, 4) AS budget, round(revenue, 4) AS revenue, round((revenue - base) / abs(CASE WHEN abs(budget - 60000) > 1 THEN budget - 60000 ELSE 1000 END), 6) AS marginal_roas
FROM (SELECT scenario, budget, sum(revenue) AS revenue FROM x_sweep GROUP BY 1, 2), (SELECT sum(revenue) AS base FROM x_sweep WHERE scenario = '15')
""")
def m09(spark, sf):
    return rounded(B.scenario_sweep(greedy_params(spark, sf), 60000.0, FLOORS), 4, marginal_roas=6)


view("x_cspend", "SELECT channel, sum(spend) AS spend FROM x_spend GROUP BY 1")


def channel_spend(spark, sf):
    return spend_daily(spark, sf).groupBy("channel").agg(F.sum("spend").alias("spend"))


@check("m10_marginal_returns", f"""
SELECT channel, round(spend, 2) AS spend, round(({_rev('(spend + st / 2)')} - {_rev('greatest(spend - st / 2, 0)')}) / st, 6) AS marginal_roi
FROM (SELECT w.*, spend, greatest(spend * 0.01, 100) AS st, 1.0 AS sf FROM x_wide w JOIN x_cspend USING (channel))
""")
def m10(spark, sf):
    return rounded(B.marginal_returns(curve_params(spark, sf), channel_spend(spark, sf)), 6, spend=2)


view("x_measured", "SELECT channel, CASE channel WHEN 'error' THEN -1.0 WHEN 'view' THEN 0.0 ELSE 1.5 + ascii(channel) % 3 END AS iroas FROM x_cspend WHERE channel <> 'signup'")


def measured(spark, sf):
    v = F.when(F.col("channel") == "error", -1.0).when(F.col("channel") == "view", 0.0).otherwise(1.5 + F.ascii("channel") % 3)
    return channel_spend(spark, sf).filter("channel <> 'signup'").select("channel", v.alias("iroas"))


@check("m11_calibrated_scales", f"""
SELECT channel, outcome, round(CASE WHEN hit THEN scale * iroas / m ELSE scale END, 4) AS scale, hit AS calibrated FROM (
  SELECT *, coalesce(m >= 0.000000001 AND o = min(CASE WHEN m >= 0.000000001 THEN o END) OVER (PARTITION BY channel), false) AS hit FROM (
    SELECT *, CASE WHEN spend > 0 AND iroas > 0 THEN (scale * {share('(spend + st / 2)', 'alpha', 'gamma')} - scale * {share('greatest(spend - st / 2, 0)', 'alpha', 'gamma')}) / st END AS m
    FROM (SELECT p.channel, p.outcome, p.scale, p.alpha, p.gamma, c.spend, x.iroas, greatest(c.spend * 0.01, 100) AS st, CASE p.outcome WHEN 'shopify' THEN 0 ELSE 1 END AS o
          FROM x_params p JOIN x_cspend c USING (channel) LEFT JOIN x_measured x USING (channel))))
""")
def m11(spark, sf):
    c = B.calibrate_scales(curve_params(spark, sf).drop("spend", "spend_max"), measured(spark, sf), channel_spend(spark, sf))
    return rounded(c.select("channel", "outcome", "scale", "calibrated"), 4)


# ---- priors and results ---------------------------------------------------------------------

view("x_attr", "SELECT CASE channel WHEN 'click' THEN 'meta_performance' WHEN 'view' THEN 'tiktok' ELSE channel END AS channel, date, k * 10.0 AS attributed_revenue FROM x_events WHERE channel <> 'error'")
view("x_attr_spend", "SELECT CASE channel WHEN 'click' THEN 'meta_performance' WHEN 'view' THEN 'tiktok' ELSE channel END AS channel, sum(spend) AS spend FROM x_events WHERE channel <> 'signup' GROUP BY 1")
view("x_shares2", "SELECT channel, sum(attributed_revenue) AS revenue, sum(attributed_revenue) / sum(sum(attributed_revenue)) OVER () AS share FROM x_attr GROUP BY 1")


def _alias(c):
    return F.when(c == "click", "meta_performance").when(c == "view", "tiktok").otherwise(c).alias("channel")


def attribution(spark, sf):
    return spend_events(spark, sf).filter("channel <> 'error'").select(_alias(F.col("channel")), "date", (F.col("k") * 10.0).alias("attributed_revenue"))


def attribution_spend(spark, sf):
    return spend_events(spark, sf).filter("channel <> 'signup'").select(_alias(F.col("channel")), "spend")


@check("a17_attribution_shares", "SELECT channel, round(revenue, 2) AS revenue, round(share, 6) AS share FROM x_shares2")
def a17(spark, sf):
    return rounded(M.attribution_shares(attribution(spark, sf)).drop("grand"), 6, revenue=2)


_PD = "CASE channel WHEN 'meta_performance' THEN 0.65 WHEN 'tiktok' THEN 0.65 ELSE 1.0 END"


@check("a18_prior_means", f"SELECT channel, round(CASE WHEN coalesce(spend, 0) > 0 THEN revenue / spend ELSE 0 END * {_PD}, 6) AS prior_mean FROM x_shares2 LEFT JOIN x_attr_spend USING (channel)")
def a18(spark, sf):
    return rounded(M.prior_means(attribution(spark, sf), attribution_spend(spark, sf), 1.0))


@check("a18_prior_means_without_spend", f"SELECT channel, round(share * 1000000 / revenue * {_PD}, 6) AS prior_mean FROM x_shares2")
def a18b(spark, sf):
    return rounded(M.prior_means(attribution(spark, sf), None, 1000000.0))


view("x_chres", """
SELECT c.*, cm / greatest(cm * 0.3, 1.0) AS roi_mean, coalesce(a.rhat, b.rhat, 1.0) AS rhat FROM (
  SELECT channel, outcome, avg(contribution_mean) AS cm, avg(contribution_p10) AS c10, avg(contribution_p90) AS c90, avg(contribution_mean) / sum(sum(contribution_mean)) OVER (PARTITION BY outcome) AS cs
  FROM x_contrib GROUP BY 1, 2) c LEFT JOIN x_rhat a ON a.parameter = 'beta_' || channel || '_' || outcome LEFT JOIN x_rhat b ON b.parameter = 'beta_' || channel
""")


def results(spark, sf):
    return M.channel_results(contributions(spark, sf), rhats(spark, sf))


@check("a19_channel_results", """
SELECT channel, outcome, round(cm, 6) AS contribution_mean, round(c10, 6) AS contribution_p10, round(c90, 6) AS contribution_p90, round(cs, 8) AS contribution_share,
       round(roi_mean, 6) AS roi_mean, round(roi_mean * 0.7, 6) AS roi_p10, round(roi_mean * 1.3, 6) AS roi_p90, round(roi_mean * 0.8, 6) AS marginal_roi, round(rhat, 6) AS rhat FROM x_chres
""")
def a19(spark, sf):
    return rounded(results(spark, sf), 6, contribution_share=8)


@check("m13_channel_iroas", """
SELECT channel, outcome, round(i, 4) AS iroas, CASE WHEN x IS NOT NULL THEN 'geo_holdout' ELSE 'mmm' END AS iroas_source,
       round(greatest(least(CASE WHEN spend > 0 THEN i * spend ELSE b END / b, 2), 0), 4) AS incremental_order_ratio, CASE WHEN i * spend / 75 > 0 THEN round(spend / (i * spend / 75), 2) ELSE 0 END AS cpia
FROM (SELECT channel, outcome, coalesce(m.iroas, roi_mean) AS i, m.iroas AS x, c.spend, greatest(cm, 0.000001) AS b FROM x_chres JOIN x_cspend c USING (channel) LEFT JOIN x_measured m USING (channel))
""")
def m13(spark, sf):
    return M.channel_iroas(results(spark, sf), channel_spend(spark, sf), measured(spark, sf))


@check("m27_current_vs_optimal", """
SELECT channel, round(cur, 4) AS current_spend, round(spend, 4) AS optimal_spend, round(spend - cur, 4) AS change
FROM (SELECT channel, cs / sum(cs) OVER () * 60000 AS cur FROM x_chres WHERE outcome = 'shopify') LEFT JOIN x_alloc a USING (channel) WHERE a.scenario = 'base'
""")
def m27(spark, sf):
    return rounded(B.current_vs_optimal(results(spark, sf), allocation(spark, sf).filter("scenario = 'base'"), 60000.0), 4)
