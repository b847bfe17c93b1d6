import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by, day, noise, one
from liftfield.functions import scalars as S
from liftfield.operators import budget as B, gates as G, media as M, monitor as O, response as H


def curves(spark):
    rows = []
    for i, c in enumerate(("a", "b", "c", "d")):
        rows += [(c, "shopify", 1e6 * (1 + i * 0.5), 1.2, 80000.0 + 20000 * i), (c, "amazon", 3e5 + 1e5 * i, 1.0, 60000.0)]
    return spark.createDataFrame(rows, "channel string, outcome string, scale double, alpha double, gamma double")


def test_allocation_respects_its_constraints(spark):
    a = by(B.allocate(curves(spark), {"x": 400000.0}, {"a": 50000.0}), "channel")
    spend = {k: v["spend"] for k, v in a.items()}
    assert sum(spend.values()) == pytest.approx(400000.0)
    assert spend["a"] >= 50000.0 and max(spend.values()) <= 0.55 * 400000 + 1e-6 and min(spend.values()) >= 0


def test_allocation_beats_random_ones(spark):
    rows = curves(spark).collect()

    def revenue(spend):
        total = 0.0
        for r in rows:
            x = spend[r["channel"]]
            w = 0.7 if r["outcome"] == "shopify" else 0.3
            total += w * r["scale"] * x ** r["alpha"] / (x ** r["alpha"] + r["gamma"] ** r["alpha"])
        return total

    best = {k: v["spend"] for k, v in by(B.allocate(curves(spark), {"x": 400000.0}), "channel").items()}
    rng = np.random.default_rng(0)
    for _ in range(3000):
        w = rng.dirichlet(np.ones(4))
        if w.max() <= 0.55:
            assert revenue(dict(zip("abcd", w * 400000))) <= revenue(best) * 1.002


def test_allocation_rejects_bad_arguments(spark):
    for kw in ({"budgets": {"x": -1.0}}, {"budgets": {"x": 10.0}, "floors": {"a": 11.0}}, {"budgets": {"x": 10.0}, "weights": {"shopify": 0.9, "amazon": 0.3}}):
        with pytest.raises(ValueError):
            B.allocate(curves(spark), **kw)


def test_greedy_ranking_equals_the_loop(spark):
    params = {"a": (4.0, 30000.0, 0.7), "b": (2.5, 50000.0, 1.4), "c": (3.0, 15000.0, 0.9)}
    p = spark.createDataFrame([(k, *v) for k, v in params.items()], "channel string, alpha double, kappa double, gamma double")
    n, budget = 200, 60000.0

    def rev(x, a, k, g):
        return a * x**g / (k**g + x**g) * x if x > 0 else 0.0

    alloc = {c: max({"b": 5000.0}.get(c, 0.0), budget * 0.01) for c in params}
    step = (budget - sum(alloc.values())) / n
    for _ in range(n):
        best = max(params, key=lambda c: (rev(alloc[c] + 500, *params[c]) - rev(alloc[c], *params[c])) / 500)
        alloc[best] += step
    got = {k: v["spend"] for k, v in by(B.greedy_allocation(p, {"x": budget}, {"b": 5000.0}, n), "channel").items()}
    assert got == pytest.approx(alloc)


def test_calibration_touches_the_first_outcome_only(spark):
    c = curves(spark)
    spend = spark.createDataFrame([("a", 50000.0), ("b", 0.0)], "channel string, spend double")
    causal = spark.createDataFrame([("a", 2.5), ("b", 2.0)], "channel string, iroas double")
    out = by(B.calibrate_scales(c, causal, spend), "channel", "outcome")
    assert out[("a", "shopify")]["calibrated"] and not out[("a", "amazon")]["calibrated"] and not out[("b", "shopify")]["calibrated"]
    r = out[("a", "shopify")]
    f = lambda x: r["scale"] * x ** r["alpha"] / (x ** r["alpha"] + r["gamma"] ** r["alpha"])
    assert (f(50250.0) - f(49750.0)) / 500 == pytest.approx(2.5)


def test_adstock_impulses(spark):
    x = spark.createDataFrame([("g", day(i), 100.0 if i == 0 else 0.0) for i in range(5)], "geo string, date date, x double")
    geo = [r["adstock"] for r in M.geometric_adstock(x, 0.5, 2, ["geo"]).orderBy("date").collect()]
    assert geo == pytest.approx([100.0, 50.0, 25.0, 0.0, 0.0])
    wei = [r["adstock"] for r in M.weibull_adstock(x, 1.0, 2.0, 1.0, 2, ["geo"]).orderBy("date").collect()]
    cdf = [1 - math.exp(-i / 2) for i in range(4)]
    assert wei == pytest.approx([100 + 100 * cdf[1], 100 * (cdf[2] - cdf[1]), 100 * (cdf[3] - cdf[2]), 0.0, 0.0])
    with pytest.raises(ValueError):
        M.geometric_adstock(x, 1.0, 2, ["geo"])


def test_population_weights(spark):
    schema = "geo string, population double"
    got = by(M.population_weights(spark.createDataFrame([("a", 100.0), ("b", 300.0)], schema)), "geo")
    assert got["a"]["weight"] == 0.25 and got["b"]["weight"] == 0.75
    with pytest.raises(Exception, match="population total"):
        M.population_weights(spark.createDataFrame([("a", 0.0)], schema)).collect()


def test_kpi_panel_gap_rules(spark):
    rows = [(g, day(7 * w), 500.0) for g in ("a", "b") for w in range(8) if not (g == "b" and w == 3)]
    other = [(g, day(7 * w), 200.0) for g in ("a", "b") for w in range(1, 9)]
    mk = lambda r: spark.createDataFrame(r, "geo string, date date, revenue double")
    markets = spark.createDataFrame([("a",), ("b",), ("c",)], "geo string")
    k = by(M.kpi_panel({"store": mk(rows), "market": mk(other)}, markets), "geo", "date")
    assert len(k) == 3 * 7
    assert k[("b", day(21))]["store"] is None and k[("c", day(21))]["store"] == 0.0 and k[("a", day(21))]["market"] == 200.0


def test_channel_effects_are_found(spark):
    rows, kpi = [], []
    for g in range(8):
        for d in range(120):
            f = {c: (1 + noise(c, g, d)) / 2 for c in ("x", "y", "z")}
            rows += [(day(d), f"g{g}", c, v) for c, v in f.items()]
            kpi.append((day(d), f"g{g}", 1000.0 * (g + 1) + 300 * f["x"] + 100 * f["y"] - 200 * f["z"]))
    feats = spark.createDataFrame(rows, "date date, geo string, channel string, feature double")
    k = spark.createDataFrame(kpi, "date date, geo string, store double")
    e = by(M.fit_channel_effects(feats, k, "store", ["x", "y", "z"], ridge=1e-4), "channel")
    assert e["x"]["effect"] == pytest.approx(300, rel=0.15) and e["y"]["effect"] == pytest.approx(100, rel=0.3)
    assert e["z"]["effect"] == 0.0 and not e["z"]["is_kept"]
    # the same numbers as the library's weighted ridge on the rows
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    turn = 2 * math.pi * F.dayofyear("date") / 365.25
    wide = feats.where("channel <> 'z'").groupBy("date", "geo").pivot("channel").agg(F.first("feature")).join(k, ["date", "geo"])
    wide = wide.join(k.groupBy("geo").agg(F.avg("store").alias("level")), "geo").select("x", "y", "level", F.sin(turn).alias("s"), F.cos(turn).alias("c"), "store", (F.substring("geo", 2, 1).cast("double") + 1).alias("w"))
    model = LinearRegression(featuresCol="v", labelCol="store", weightCol="w", regParam=50.0, solver="normal").fit(VectorAssembler(inputCols=["x", "y", "level", "s", "c"], outputCol="v").transform(wide))
    weights = k.select("geo").distinct().withColumn("weight", F.substring("geo", 2, 1).cast("double") + 1)
    draws = by(M.channel_effect_draws(feats, k, ["store"], ["x", "y", "z"], weights, 50.0, 30), "replicate", "channel")
    assert [draws[0, c]["effect"] for c in "xy"] == pytest.approx(model.coefficients[:2], rel=1e-6)
    drawn = [draws[b, "x"]["effect"] for b in range(1, 31)]
    assert len(draws) == 31 * 3 and len(set(drawn)) > 20 and abs(sum(drawn) / 30 - draws[0, "x"]["effect"]) < 3 * max(abs(v - drawn[0]) for v in drawn)


def test_rhat_flags_chains_that_disagree(spark):
    rows = [(p, c, noise(p, c, i) + (3.0 if p == "bad" and c == 0 else 0.0)) for p in ("good", "bad") for c in range(4) for i in range(200)]
    r = by(M.rhat(spark.createDataFrame(rows, "parameter string, chain int, value double")), "parameter")
    assert r["good"]["rhat"] < 1.05 and not r["good"]["is_high"] and r["bad"]["rhat"] > 1.2


def test_hill_slope_is_the_derivative(spark):
    x = spark.createDataFrame([(float(v),) for v in (1, 10, 55, 400)], "x double")
    args = (F.lit(900.0), F.lit(60.0), F.lit(0.8))
    num = (S.hill_revenue(F.col("x") + 1e-4, *args) - S.hill_revenue(F.col("x") - 1e-4, *args)) / 2e-4
    for r in x.select(S.hill_slope(F.col("x"), *args).alias("a"), num.alias("b")).collect():
        assert r["a"] == pytest.approx(r["b"], rel=1e-5)


def points(spark, n=20, r_max=500.0, k=60.0, a=0.9, test="t"):
    rows = []
    for i in range(n):
        x = 5.0 + 12 * i
        rows.append((test, f"g{i:02d}", x, r_max * x**a / (k**a + x**a) * (1 + 0.01 * noise(i)), 1.0))
    return spark.createDataFrame(rows, "test_id string, geo string, x double, y double, organic_growth double")


def test_hill_fit_recovers_its_parameters(spark):
    f = one(H.fit_response(points(spark)))
    assert f["converged"] and f["alpha"] == pytest.approx(0.9, abs=0.12)
    pred = lambda x: f["r_max"] * x ** f["alpha"] / (f["k"] ** f["alpha"] + x ** f["alpha"])
    truth = lambda x: 500 * x**0.9 / (60**0.9 + x**0.9)
    for x in (20.0, 100.0, 200.0):
        assert pred(x) == pytest.approx(truth(x), rel=0.03)


def test_optimum_slope_meets_the_target(spark):
    p = points(spark)
    f = H.fit_response(p)
    row = one(H.response_summary(f, p, target=1.0))
    s = row["optimal_spend"] / row["n_geos"]
    slope = lambda x: row["r_max"] * row["alpha"] * row["k"] ** row["alpha"] * x ** (row["alpha"] - 1) / (row["k"] ** row["alpha"] + x ** row["alpha"]) ** 2
    assert slope(s) < 1.0 <= slope(s * 0.98) and row["r_squared"] > 0.98
    boot = H.bootstrap_curves(p, n_boot=15)
    ci = one(H.optimum_interval(boot))
    assert ci["n_fits"] == 15 and ci["optimal_lower"] <= s * 1.05 and ci["optimal_upper"] >= s * 0.95
    few = one(H.optimum_interval(H.bootstrap_curves(p, n_boot=5)))
    assert few["optimal_upper"] == pytest.approx(4 * few["optimal_lower"])
    table = H.curve_table(f, p, boot)
    assert table.count() == 100 and table.filter("revenue_lower > revenue_upper").count() == 0


def test_response_needs_enough_markets(spark):
    rows = [("t", f"g{i}", "treatment" if i < 4 else "holdout", day(d), 100.0, 1, "pre" if d < 5 else "post") for i in range(6) for d in range(9)]
    p = spark.createDataFrame(rows, "test_id string, geo string, cell string, date date, revenue double, orders int, period string")
    spend = lambda n: spark.createDataFrame([("t", f"g{i}", 5.0) for i in range(n)], "test_id string, geo string, spend double")
    assert H.response_points(H.market_levels(p, spend(4))).count() == 4
    assert H.response_points(H.market_levels(p, spend(2))).count() == 0
    assert H.response_points(H.market_levels(p.filter("geo <> 'g5'"), spend(4))).count() == 0


def test_mape_and_rolling_error(spark):
    rows = [(day(i), 100.0, 100.0 + i) for i in range(10)] + [(day(600), 100.0, 150.0)]
    e = spark.createDataFrame(rows, "date date, actual double, predicted double")
    assert one(O.mape(e.limit(2), []))["mape"] == pytest.approx(0.005)
    got = by(O.rolling_error(e), "date")
    assert len(got) == 11
    assert got[day(9)]["mape"] == pytest.approx(np.mean([i / 100 for i in range(3, 10)])) and got[day(600)]["needs_refit"]


def test_rolling_error_across_block_edges(spark):
    first = dt.date(1970, 1, 1) + dt.timedelta(days=512 * 40 - 4)
    rows = [(first + dt.timedelta(days=i), 100.0, 100.0 + i) for i in range(12)]
    got = by(O.rolling_error(spark.createDataFrame(rows, "date date, actual double, predicted double")), "date")
    for i in range(12):
        assert got[first + dt.timedelta(days=i)]["mape"] == pytest.approx(np.mean([j / 100 for j in range(max(0, i - 6), i + 1)]))


def test_average_rank_shares_ties(spark):
    d = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 3.0), ("d", 1.0)], "geo string, v double")
    got = {k: v["rank"] for k, v in by(O.average_rank(d, "v"), "geo").items()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 4}


def test_drop_rules(spark):
    w = spark.createDataFrame([("x", 1, 100.0), ("x", 2, 70.0), ("x", 3, 0.0), ("x", 4, 5.0)], "channel string, week int, value double")
    got = [r["is_alert"] for r in O.weekly_drops(w, ["channel"], "value", 20.0).orderBy("week").collect()]
    assert got == [False, True, True, False]


def test_exclusion_plan_and_revert(spark):
    cells = spark.createDataFrame([("t", "501", "holdout"), ("t", "803", "holdout"), ("t", "602", "treatment")], "test_id string, geo string, cell string")
    sets = spark.createDataFrame([("t", "none", []), ("t", "part", ["501", "999"]), ("t", "full", ["501", "803"]), ("t", "kept", [])],
                                 "test_id string, adset_id string, excluded array<string>")
    managed = sets.filter("adset_id = 'kept'")
    plan = O.exclusion_plan(sets, cells, managed)
    assert {(r["adset_id"], r["geo"]) for r in plan.collect()} == {("none", "501"), ("none", "803"), ("part", "803")}
    snaps = O.targeting_snapshots(sets, plan)
    assert {r["adset_id"] for r in snaps.collect()} == {"none", "part"}
    later = snaps.withColumn("excluded", F.array(F.lit("501"))).withColumn("taken_at", F.lit(2))
    back = by(O.revert_plan(snaps.withColumn("taken_at", F.lit(1)).unionByName(later)), "adset_id")
    assert back["part"]["excluded"] == ["501", "999"] and back["none"]["excluded"] == []


def test_panel_placebos_on_a_flat_panel(spark):
    rows = [("t", f"g{g}", day(d), 100.0 * (g + 1) * (1 + 0.01 * noise(g, d))) for g in range(8) for d in range(60)]
    p = spark.createDataFrame(rows, "test_id string, geo string, date date, value double")
    rep = one(G.placebo_report(G.placebo_halves(p, 100), G.placebo_splits(p), G.placebo_markets(p)))
    assert rep["is_passed"] and rep["bonus"] == 15 and G.placebo_markets(p).count() == 2
    jump = p.withColumn("value", F.when(F.col("date") >= day(30), F.col("value") * 1.5).otherwise(F.col("value")))
    assert not one(G.placebo_halves(jump, 100))["is_passed"]


def test_ranks_and_quantiles_in_parts(spark):
    from liftfield.operators.ranks import exact_quantiles, running_counts

    rng = np.random.default_rng(4)
    values = {"hot": rng.integers(0, 400, 3000) / 8.0, "few": np.array([2.0, 2.0, 9.0]), "one": np.array([5.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["a"], r["b"]) for r in exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.9}).collect()}
    assert got == {k: pytest.approx((np.quantile(v, 0.1), np.quantile(v, 0.9))) for k, v in values.items()}
    for down in (False, True):
        for r in running_counts(df.where("v is not null"), ["k"], "v", down).collect():
            own = values[r["k"]]
            assert r["n"] == (own == r["v"]).sum() and r["before"] == ((own > r["v"]) if down else (own < r["v"])).sum()
    ranked = O.average_rank(df.where("k = 'hot'").drop("k"), "v").select("v", "rank").distinct().collect()
    assert all(r["rank"] == int((values["hot"] > r["v"]).sum() + ((values["hot"] == r["v"]).sum() + 1) / 2) for r in ranked)
