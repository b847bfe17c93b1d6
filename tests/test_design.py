import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import PANEL_SCHEMA, by, day, noise, one, panel_rows
from liftfield.operators import assign, design, power, spillover
from liftfield.plans.design import DesignSettings, auto_design


def variance_row(spark, **kw):
    base = dict(test_id="t", within_var=10000.0, between_var=50000.0, total_var=60000.0, mean_daily=500.0, mean_weekly=3500.0, cv=0.07,
                n_geos=50, n_periods=12, rho=0.3, n_treatment=40, n_holdout=10)
    base.update(kw)
    return spark.createDataFrame([base])


def test_power_at_the_detectable_effect_is_the_target(spark):
    g = power.mde_grid(variance_row(spark)).filter("weeks = 4")
    assert 0.78 <= one(g)["power"] <= 0.85


def test_detectable_effect_by_hand(spark):
    r = one(power.mde_grid(variance_row(spark)).filter("weeks = 4"))
    eff = max(4 * 0.7 / 1.3, 1.0)
    v = 10000 / eff
    assert r["mde"] == pytest.approx((1.959964 + 0.841621) * math.sqrt(v / 40 + v / 10) / 3500, rel=1e-5)


def test_high_variance_asks_for_many_holdouts(spark):
    v = variance_row(spark, within_var=500000.0, mean_weekly=700.0, n_geos=210)
    assert one(design.best_holdout_size(v, ["test_id"]))["n_holdout"] >= 20


def test_duration_search(spark):
    v = variance_row(spark, rho=0.0)
    mdes = {r["weeks"]: r["mde"] for r in power.mde_grid(v).collect()}
    goal = mdes[5] * 1.0001
    assert one(power.required_duration(v, ["test_id"], goal))["weeks"] == 5
    assert one(power.required_duration(v, ["test_id"], 1e-6))["weeks"] == 12
    assert one(power.power_result(v, ["test_id"], goal))["duration_weeks"] == 5


def test_power_score_is_monotone(spark):
    rows = spark.createDataFrame([(p / 20.0,) for p in range(21)], "p double")
    got = [r[0] for r in rows.select(power.power_score(F.col("p"), F.lit(0.05), F.lit(0.12), F.lit(12))).collect()]
    assert got == sorted(got) and got[-1] == 40 + 20 + 20 + 10


def market_rows(n, tests=("a", "b")):
    cov = design.COVARIATES
    return [(t, f"m{i:02d}", *[100 * (1 + noise(c, i)) for c in cov], 5) for t in tests for i in range(n)], \
        "test_id string, geo string, " + ", ".join(f"{c} double" for c in cov) + ", n_holdout int"


def test_greedy_pairs_equal_the_sequential_matching(spark):
    rows, schema = market_rows(17)
    points = design.whitened(spark.createDataFrame(rows, schema))
    got = {}
    for r in design.greedy_pairs(points, first_reach=0.7, growth=2.0).collect():
        got.setdefault(r["test_id"], set()).add((r["a"], r["b"]))
    x = np.array([r[2:8] for r in rows if r[0] == "a"])
    inv = np.linalg.inv(np.cov(x.T))
    edges = sorted((math.sqrt((x[i] - x[j]) @ inv @ (x[i] - x[j])), i, j) for i, j in itertools.combinations(range(17), 2))
    used, want = set(), set()
    for _, i, j in edges:
        if i not in used and j not in used:
            used |= {i, j}
            want.add((f"m{i:02d}", f"m{j:02d}"))
    assert got["a"] == want and got["b"] == want


def test_mahalanobis_assignment_sizes(spark):
    rows, schema = market_rows(13)
    out = by(design.mahalanobis_assignment(spark.createDataFrame(rows, schema)).groupBy("test_id", "cell").count(), "test_id", "cell")
    assert out[("a", "holdout")]["count"] == 5 and out[("a", "treatment")]["count"] == 8


def test_rerandomisation_keeps_the_best_candidate(spark):
    rows, schema = market_rows(14)
    m = spark.createDataFrame(rows, schema)
    scores = design.candidate_scores(m, 200, tolerance=0.6)
    best = by(design.best_candidate(scores), "test_id")["a"]
    every = scores.filter("test_id = 'a'").collect()
    passing = [r for r in every if r["is_balanced"]] or every
    assert best["balance_score"] == max(r["balance_score"] for r in passing)
    chosen = design.rerandomised_assignment(m, 200, tolerance=0.6)
    check = one(design.balance_scores(chosen.filter("test_id = 'a'"), ["test_id"], tolerance=0.6))
    assert check["balance_score"] == pytest.approx(best["balance_score"])
    assert chosen.filter("test_id = 'a' AND cell = 'holdout'").count() == 5


def test_stratified_counts(spark):
    rows = [("t", f"g{i}", "N") for i in range(10)] + [("t", f"h{i}", "S") for i in range(3)] + [("t", "x", "W")]
    out = assign.stratified_assignment(spark.createDataFrame(rows, "test_id string, geo string, region string"), 5)
    got = {r["region"]: r["n"] for r in out.groupBy("region").agg(F.count_if(F.col("cell") == "holdout").alias("n")).collect()}
    assert got == {"N": 4, "S": 1, "W": 0}


def test_backtest_statistics_equal_a_direct_calculation(spark):
    p = spark.createDataFrame(panel_rows(n_t=5, n_h=4, n_pre=50, n_post=0), PANEL_SCHEMA)
    got = by(power.backtest_statistics(p, 14), "split", "effect")
    pdf = p.toPandas().sort_values("date")
    dates = sorted(pdf.date.unique())
    assert {k[0] for k in got} == set(range(14, 37))
    for split, effect in ((14, 0.0), (25, 0.10), (36, 0.20)):
        last = min(split + 14, 49)
        pre = pdf[pdf.date < dates[split]].groupby("geo").revenue.mean()
        post = pdf[(pdf.date >= dates[split]) & (pdf.date <= dates[last])].groupby("geo").revenue.mean()
        cells = pdf.groupby("geo").cell.first()
        d = post * np.where(cells == "treatment", 1 + effect, 1.0) - pre
        t, h = d[cells == "treatment"], d[cells == "holdout"]
        s = math.sqrt(((len(t) - 1) * t.var() + (len(h) - 1) * h.var()) / (len(d) - 2) * (1 / len(t) + 1 / len(h)))
        assert got[(split, effect)]["t_stat"] == pytest.approx((t.mean() - h.mean()) / s, rel=1e-6)
    assert power.backtest_statistics(p, 40).count() == 0


def test_backtest_power_grows_with_the_effect(spark):
    p = spark.createDataFrame(panel_rows(n_t=10, n_h=8, n_pre=70, n_post=0, sd=0.2), PANEL_SCHEMA)
    got = {r["effect"]: r for r in power.backtest_power(p, 14, 60).collect()}
    assert got[0.0]["n_sims"] == 30 and got[0.2]["n_sims"] == 60
    assert got[0.0]["detected"] <= 0.4 and got[0.2]["detected"] >= got[0.05]["detected"]
    sizes = spark.createDataFrame([("t", 8)], "test_id string, n_holdout int")
    s = one(power.backtest_summary(power.backtest_power(p, 14, 60), sizes))
    assert 0 <= s["power_score"] <= 100 and s["mde"] in (0.05, 0.10, 0.15, 0.20)


def test_buffer_modes(spark):
    cells = spark.createDataFrame([("t", f"t{i}", "treatment") for i in range(6)] + [("t", f"h{i}", "holdout") for i in range(7)], "test_id string, geo string, cell string")
    e = spark.createDataFrame([("t0", "h0"), ("t1", "h0"), ("t1", "h1"), ("t2", "h2"), ("t3", "h2"), ("t4", "h2"), ("t0", "t1")], "src string, dst string")
    flagged = lambda least: {r["geo"] for r in spillover.geographic_buffer(e, cells, least).filter("in_buffer").collect()}
    assert flagged(4) == {"h0", "h1", "h2", "t0", "t1", "t2", "t3", "t4"}
    assert flagged(5) == {"h2", "h0"}
    assert flagged(7) == set()
    r = one(spillover.spillover_risk(e, cells))
    assert r["n_border_pairs"] == 6 and r["risk_score"] == pytest.approx(3 / 7) and r["risk_level"] == "high"


def test_centroid_edges_lose_nothing(spark):
    rng = random.Random(5)
    pts = [(f"p{i}", rng.uniform(25, 48), rng.uniform(-122, -70)) for i in range(120)]

    def miles(a, b):
        la1, lo1, la2, lo2 = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        return 2 * 3959 * math.asin(math.sqrt(h))

    want = {(a[0], b[0]) for a in pts for b in pts if a != b and miles(a, b) <= 175}
    got = {(r["src"], r["dst"]) for r in spillover.centroid_edges(spark.createDataFrame(pts, "geo string, lat double, lon double")).collect()}
    assert got == want and want


def test_weekly_trend_counts_empty_weeks(spark):
    rows = [("g", day(i), 10.0) for i in range(7)] + [("g", day(21 + i), 20.0) for i in range(7)] + [("s", day(0), 1.0)]
    r = by(design.weekly_trend(spark.createDataFrame(rows, "geo string, date date, revenue double")), "geo")
    weeks = [70.0, 0.0, 0.0, 140.0]
    assert set(r) == {"g"} and r["g"]["revenue_volatility"] == pytest.approx(np.std(weeks, ddof=1) / np.mean(weeks))
    assert r["g"]["revenue_trend"] == pytest.approx(-1.0)


def test_lifecycle_guards(spark):
    steps = ["update", "execute", "execute", "update", "revert", "update", "execute", "revert", "analyze", "execute"]
    for gap in (1, 12, 40):  # within one month, across a few, one event a month
        e = spark.createDataFrame([("t", day(i * gap), i, a) for i, a in enumerate(steps)], "test_id string, at date, seq int, action string")
        got = [r["is_allowed"] for r in design.lifecycle(e).orderBy("seq").collect()]
        assert got == [False, True, False, True, True, False, True, True, True, False]


def test_auto_design_is_complete(spark):
    daily = [("a", f"m{g:02d}", day(d), 1000 * (1 + 0.3 * noise(g)) * (1 + 0.05 * noise(g, d))) for g in range(24) for d in range(140)]
    daily += [("tiny", f"m{g:02d}", day(d), 1.0) for g in range(4) for d in range(20)]
    rows, schema = market_rows(24, ("a",))
    small, _ = market_rows(4, ("tiny",))
    m = spark.createDataFrame(rows + small, schema).drop("n_holdout")
    edges = spark.createDataFrame([("m00", "m01"), ("m02", "m03")], "src string, dst string")
    d, cells = auto_design(spark.createDataFrame(daily, "test_id string, geo string, date date, revenue double"), m, edges, "2024-06-03",
                           DesignSettings(n_candidates=300, n_simulations=20))
    r = one(d)
    assert r["test_id"] == "a" and str(r["start_date"]) == "2024-06-10"
    assert (r["end_date"] - r["start_date"]).days == 7 * r["duration_weeks"]
    assert r["n_treatment_all"] + r["n_holdout_all"] == 24 and cells.count() == 24
    assert r["method"] == "rerandomised" and r["scope"] == "channel" and r["campaign_ids"] == []
    with pytest.raises(ValueError):
        DesignSettings(alpha=1.5)


def test_unserved_tests_get_matched_pairs(spark):
    rows, schema = market_rows(12, ("a", "b"))
    m = spark.createDataFrame(rows, schema)
    m = m.withColumn("n_holdout", F.when(F.col("test_id") == "b", 12).otherwise(F.col("n_holdout")))  # no second cell: no balance
    got = design.assigned_with_fallback(m, 60, tolerance=5.0)
    assert {(r["test_id"], r["method"]) for r in got.select("test_id", "method").distinct().collect()} == {("a", "rerandomised"), ("b", "matched_pairs")}
    assert got.count() == 24
    strict = design.assigned_with_fallback(m.filter("test_id = 'a'"), 60, tolerance=0.0, must_balance=True)
    cells = by(strict.groupBy("cell", "method").agg(F.count("*").alias("n")), "cell", "method")
    held = m.filter("test_id = 'a'").first()["n_holdout"]
    assert cells["holdout", "matched_pairs"]["n"] == min(held, 12 - held) and len(cells) == 2


def test_campaign_scope_takes_its_own_spend(spark):
    m = spark.createDataFrame([("a", "x", 9.0), ("a", "y", 9.0), ("b", "x", 7.0)], "test_id string, geo string, total_ad_spend double")
    spend = spark.createDataFrame([("x", "c1", 1.0), ("x", "c1", 2.0), ("x", "c2", 4.0), ("x", "c3", 8.0)], "geo string, campaign_id string, spend double")
    wanted = spark.createDataFrame([("a", "c1"), ("a", "c2"), ("a", "c2")], "test_id string, campaign_id string")
    got = {(r["test_id"], r["geo"]): r["total_ad_spend"] for r in design.campaign_scope(m, spend, wanted).collect()}
    assert got == {("a", "x"): 7.0, ("a", "y"): 0.0, ("b", "x"): 7.0}


def test_backtests_of_several_lengths_in_one_job(spark):
    from liftfield.operators import power

    rows = [(t, f"g{g}", "treatment" if g < 5 else "holdout", day(d), 100.0 + noise(t, g, d)) for t in "ab" for g in range(8) for d in range(70)]
    p = spark.createDataFrame(rows, "test_id string, geo string, cell string, date date, revenue double")
    lengths = spark.createDataFrame([("a", 14), ("b", 21)], "test_id string, post_days int")
    both = {(r["test_id"], r["effect"]): r["detected"] for r in power.backtest_power(p, lengths, 20).collect()}
    for t, days in (("a", 14), ("b", 21)):
        alone = power.backtest_power(p.filter(F.col("test_id") == t), days, 20).collect()
        assert alone and all(both[t, r["effect"]] == r["detected"] for r in alone)


def test_greedy_pairs_end_on_unusable_markets(spark):
    rows = [("t", "a", None, 0.0), ("t", "b", float("nan"), 1.0), ("t", "c", 0.0, 0.0), ("t", "d", 0.2, 0.0), ("t", "d", 0.2, 0.0), ("t", "e", 900.0, 0.0),
            ("t", "f", float("inf"), 0.0), ("u", "a", None, None), ("u", "b", None, None)]
    got = design.greedy_pairs(spark.createDataFrame(rows, "test_id string, geo string, z0 double, z1 double")).collect()
    assert [(r["test_id"], r["a"], r["b"]) for r in got] == [("t", "c", "d")]


def test_draws_differ_between_tests(spark):
    rows = [(t, f"g{k:02d}", "treatment" if k < 6 else "holdout", float(k * k)) for t in ("x", "y") for k in range(12)]
    from liftfield.operators.causal import bootstrap_effects

    got = bootstrap_effects(spark.createDataFrame(rows, "test_id string, geo string, cell string, diff double"), n_boot=20).collect()
    by_test = {t: [r["tau"] for r in sorted(got, key=lambda r: r["rep"]) if r["test_id"] == t] for t in ("x", "y")}
    assert len(by_test["x"]) == 20 and by_test["x"] != by_test["y"]


def test_incremental_and_organic_revenue_stay_within_the_cell(spark, make_panel):
    from liftfield.operators import causal, returns

    panel = make_panel(lift=0.1)
    cells = panel.select("test_id", "geo", "cell").distinct()
    scale = cells.groupBy("test_id").agg(F.count_if(F.col("cell") == "treatment").alias("n_treatment")).withColumn("n_days", F.lit(21))
    money = one(returns.incremental_revenue(causal.difference_in_differences(panel, n_boot=300), scale))
    sold = panel.filter("cell = 'treatment' AND period = 'post'").agg(F.sum("revenue")).first()[0]
    assert money["incremental_lower"] <= money["incremental_revenue"] <= money["incremental_upper"]
    # a lift of a tenth leaves ten elevenths of what the cell sold
    assert sold / 11 * 0.8 < money["incremental_revenue"] < sold / 11 * 1.2


def test_edges_around_the_globe(spark):
    from liftfield.operators import spillover

    rng = random.Random(8)
    points = [(f"p{k}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(300)]
    points += [(f"d{k}", rng.uniform(-70, 70), rng.choice([179.5, -179.6, 180.0, -180.0])) for k in range(60)]
    points += [(f"n{k}", rng.choice([89.2, 88.0, -89.7]), rng.uniform(-180, 180)) for k in range(40)] + [("top", 90.0, 0.0), ("bottom", -90.0, 12.0), ("zero", 0.0, 0.0), ("near", 0.01, 0.01)]

    def miles(a, b):
        la, lb = math.radians(a[1]), math.radians(b[1])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 3959.0 * math.asin(math.sqrt(min(h, 1.0)))

    for reach in (175.0, 900.0):
        want = {(a[0], b[0]) for a in points for b in points if a[0] != b[0] and miles(a, b) <= reach}
        got = [(r["src"], r["dst"]) for r in spillover.centroid_edges(spark.createDataFrame(points, "geo string, lat double, lon double"), reach).collect()]
        assert len(got) == len(set(got)) and set(got) == want
