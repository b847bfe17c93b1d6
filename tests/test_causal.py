import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import PANEL_SCHEMA, by, day, one, panel_rows
from liftfield.functions.stats import normal_cdf, student_t_two_sided_p
from liftfield.operators import causal, panel as P, quality, returns, structural, synth, validation
from liftfield.plans import analysis


def test_did_recovers_an_injected_lift(spark, make_panel):
    r = one(causal.difference_in_differences(make_panel(lift=0.10), n_boot=400))
    assert r["relative_lift"] == pytest.approx(0.10, abs=0.02) and r["is_significant"]
    null = one(causal.difference_in_differences(make_panel(lift=0.0), n_boot=400))
    assert abs(null["relative_lift"]) < 0.03


def test_did_against_plain_python(make_panel):
    p = make_panel(lift=0.05)
    pdf = p.toPandas()
    m = pdf.groupby(["geo", "cell", "period"])["revenue"].mean().unstack("period").reset_index()
    m["d"] = m["post"] - m["pre"]
    t, h = m[m.cell == "treatment"], m[m.cell == "holdout"]
    tau = t.d.mean() - h.d.mean()
    r = one(causal.did_effects(causal.geo_changes(p)))
    assert r["absolute_lift"] == pytest.approx(tau)
    assert r["baseline"] == pytest.approx(t.pre.mean() + h.post.mean() - h.pre.mean())


def test_bootstrap_se_matches_its_limit(make_panel):
    ch = causal.geo_changes(make_panel(n_t=20, n_h=12))
    se = one(causal.bootstrap_se(ch, n_boot=3000))["se"]
    d = ch.toPandas()
    limit = math.sqrt(sum(g["diff"].var(ddof=0) / len(g) for _, g in d.groupby("cell")))
    assert se == pytest.approx(limit, rel=0.08)


def test_student_t_and_normal(spark):
    cases = [(0.0, 5), (2.0, 10), (-2.228138852, 10), (12.706204736, 1), (1.0, 30), (3.182446305, 3), (float("nan"), 4), (None, 4), (1.0, None)]
    rows = spark.createDataFrame(cases, "t double, n int").select(student_t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()
    assert [r.p for r in rows[:6]] == pytest.approx([1.0, 0.07338803, 0.05, 0.05, 0.32530862, 0.05], abs=1e-6) and {r.p for r in rows[6:]} == {None}
    row = spark.range(1).select(*[normal_cdf(F.lit(x)).alias(f"c{i}") for i, x in enumerate((-1.96, 0.0, 1.96))]).first()
    assert list(row) == pytest.approx([0.0249979, 0.5, 0.9750021], abs=1e-6)


def test_quick_p_is_one_with_a_single_market(spark):
    p = spark.createDataFrame(panel_rows(n_t=1, n_h=5), PANEL_SCHEMA)
    assert one(causal.quick_did_p(causal.geo_changes(p)))["p_value"] == 1.0


def test_conformal_p_never_zero_and_interval_ordered(spark):
    rows = [("t", "pre", day(i), (-1.0) ** i) for i in range(30)] + [("t", "post", day(30 + i), 50.0) for i in range(5)]
    g = spark.createDataFrame(rows, "test_id string, period string, date date, gap double")
    r = one(causal.conformal_inference(g, n_perm=400))
    assert 1 / 401 <= r["p_value"] < 0.05 and r["ci_lower"] < r["effect"] < r["ci_upper"]
    assert one(causal.bootstrap_p(g.filter("period = 'post'"), n_boot=100))["p_value"] == pytest.approx(1 / 101)


def brute_simplex(y, x):
    """Frank–Wolfe with exact line search, long enough to be a reference."""
    w = np.full(x.shape[1], 1 / x.shape[1])
    for _ in range(20000):
        r = y - x @ w
        i = int(np.argmax(x.T @ r))
        d = -w.copy()
        d[i] += 1
        xd = x @ d
        step = np.clip((r @ xd) / max(xd @ xd, 1e-18), 0, 1)
        w = w + step * d
    return w


def test_simplex_weights_are_feasible_and_optimal():
    rng = np.random.default_rng(1)
    x = rng.normal(10, 2, (30, 8))
    y = x @ np.array([0.5, 0.3, 0.2, 0, 0, 0, 0, 0]) + rng.normal(0, 0.05, 30)
    w = synth.simplex_weights(y, x)
    loss = lambda v: np.sum((y - x @ v) ** 2)
    assert w.min() >= 0 and w.sum() == pytest.approx(1.0)
    assert loss(w) <= loss(brute_simplex(y, x)) * (1 + 1e-4) and loss(w) < loss(np.full(8, 1 / 8))


def test_ridge_leave_one_out_matches_refits():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(15, 4)), rng.normal(size=15)
    errors = []
    for a in synth.RIDGE_GRID:
        e = [y[i] - synth.ridge_predict(np.delete(y, i), np.delete(x, i, 0), x[i : i + 1], a)[0] for i in range(15)]
        errors.append(np.mean(np.square(e)))
    assert synth.ridge_alpha(y, x) == pytest.approx(synth.RIDGE_GRID[int(np.argmin(errors))])


def test_ascm_finds_lift_and_placebos_do_not(make_panel):
    fitted = synth.ascm_series(synth.unit_series(make_panel(lift=0.15)))
    r = one(synth.ascm_results(fitted, n_perm=500))
    assert r["relative_lift"] == pytest.approx(0.15, abs=0.04) and r["l2_imbalance"] < 0.05 and r["n_placebos"] == 6
    space = analysis.placebo_in_space(fitted, n_perm=300).collect()
    assert len(space) == 6 and all(abs(x["estimated_effect"]) < 0.1 for x in space)


def test_scm_weights_table(make_panel):
    w = synth.scm_weights(synth.unit_series(make_panel()), placebos=True)
    sums = by(w.groupBy("target").agg(F.sum("weight").alias("s"), F.min("weight").alias("m"), F.count("*").alias("n")), "target")
    assert all(v["s"] == pytest.approx(1.0) and v["m"] >= 0 for v in sums.values())
    assert sums[P.TREATED_UNIT]["n"] == 6 and sums["g10"]["n"] == 5


def exact_simplex(y, x):
    """The best of the optima of all sets of donors."""
    best = None
    for size in range(1, x.shape[1] + 1):
        for chosen in itertools.combinations(range(x.shape[1]), size):
            g = x[:, chosen] - y[:, None]
            w = np.linalg.solve(g.T @ g, np.ones(size))
            w = w / w.sum()
            loss = np.sum((g @ w) ** 2)
            if w.min() >= 0 and (best is None or loss < best[0]):
                best = loss, chosen, w
    out = np.zeros(x.shape[1])
    out[list(best[1])] = best[2]
    return out


def plain_ascm(series, target):
    """Filled matrices of one target and the textbook formulas on them."""
    donors = sorted({u for u, *_ in series if u not in (P.TREATED_UNIT, target)})
    value = {(u, d): y for u, _, d, y in series if y is not None}
    everyone = [u for u in {u for u, *_ in series} if u != P.TREATED_UNIT]
    sides = {}
    for period in ("pre", "post"):
        days = sorted({d for u, p, d, y in series if p == period and u in everyone and y is not None})
        filled = []
        for u in donors:
            own, last = [value.get((u, d)) for d in days], None
            first = next((v for v in own if v is not None), 0.0)
            row = []
            for v in own:
                last = v if v is not None else last
                row.append(first if last is None else last)
            filled.append(row)
        used = [k for k, d in enumerate(days) if (target, d) in value and any((u, d) in value for u in donors)]
        sides[period] = np.array([value[target, days[k]] for k in used]), np.array(filled).T[used]
    (y0, x0), (y1, x1) = sides["pre"], sides["post"]
    w = exact_simplex(y0, x0)
    c = x0 - x0.mean(0)
    inverse = lambda a: np.linalg.inv(c.T @ c + a * np.eye(len(donors)))
    errors = []
    for a in synth.RIDGE_GRID:
        hat = c @ inverse(a) @ c.T + 1 / len(y0)
        errors.append(np.mean(((y0 - hat @ y0) / (1 - np.diag(hat))) ** 2))
    a, r = synth.RIDGE_GRID[int(np.argmin(errors))], y0 - x0 @ w
    fit = lambda x: x @ w + r.mean() + (x - x0.mean(0)) @ inverse(a) @ c.T @ (r - r.mean())
    return dict(zip(donors, w, strict=True)), np.concatenate([fit(x0), fit(x1)]), np.concatenate([y0, y1])


def test_ascm_from_products_equals_the_matrices_with_gaps(spark):
    rng = np.random.default_rng(7)
    units = [P.TREATED_UNIT, *(f"d{k}" for k in range(5))]
    base = rng.normal(0, 1, 44).cumsum() + 40
    series = [(u, "pre" if d < 30 else "post", day(d), float(base[d] * (1 + 0.1 * k) + rng.normal(0, 1))) for k, u in enumerate(units) for d in range(44)]
    # gaps of every kind: at an edge, inside, of the treated mean, a null value, a date with one donor only
    drop = {("d1", day(0)), ("d1", day(1)), ("d2", day(10)), ("d2", day(11)), (P.TREATED_UNIT, day(5)), ("d3", day(40))} | {(u, day(20)) for u in units if u != "d4"}
    series = [(u, p, d, None if (u, d) == ("d0", day(15)) else y) for u, p, d, y in series if (u, d) not in drop]
    df = spark.createDataFrame([("t", p, d, u, y) for u, p, d, y in series], "test_id string, period string, date date, unit string, y double").repartition(5)
    weights = by(synth.scm_weights(df, placebos=True), "target", "donor")
    fitted = synth.ascm_series(df).where("penalty = 'cv'").orderBy("target", "date").toPandas()
    for target in units:
        w, synthetic, y = plain_ascm(series, target)
        got = fitted[fitted.target == target]
        assert got["y"].to_numpy() == pytest.approx(y)
        assert got["synthetic"].to_numpy() == pytest.approx(synthetic, abs=1e-6)
        assert {d: weights[target, d]["weight"] if (target, d) in weights else 0.0 for d in w} == pytest.approx(w, abs=1e-6)


def test_placebo_p_counts_other_targets(spark):
    e = [1.0, 3.0, 5.0, 5.0, 8.0]
    pl = spark.createDataFrame([("t", f"d{i}", v) for i, v in enumerate(e)], "test_id string, target string, effect double")
    tau = spark.createDataFrame([("t", "*treatment*", -5.0), ("t", "d3", 5.0), ("t", "d4", 9.0)], "test_id string, target string, absolute_lift double")
    got = by(synth.placebo_p(tau, pl), "target")
    assert got["*treatment*"]["placebo_p"] == pytest.approx(3 / 5)
    assert got["d3"]["placebo_p"] == pytest.approx(2 / 4)
    assert got["d4"]["placebo_p"] == pytest.approx(1 / 5)


def test_structural_series_recovers_lift(make_panel):
    s = structural.structural_series(P.aligned_series(make_panel(lift=0.15, n_pre=60)))
    r = one(structural.structural_results(s))
    assert r["relative_lift"] == pytest.approx(0.15, abs=0.05) and 0 <= r["p_value"] <= 1


def test_short_tests_degrade(spark):
    long, short = panel_rows(lift=0.1, test="long"), panel_rows(n_pre=5, n_post=4, test="short")
    p = spark.createDataFrame(long + short, PANEL_SCHEMA)
    res = analysis.estimator_results(p, n_boot=200)
    methods = {k: sorted(r["method"] for r in res.filter(F.col("test_id") == k).collect()) for k in ("long", "short")}
    assert methods == {"long": ["ascm", "bsts", "did"], "short": ["did"]}
    tests = p.select("test_id").distinct()
    failed = {(r["test_id"], r["method"]) for r in causal.failed_methods(tests, res).collect()}
    assert failed == {("short", "ascm"), ("short", "bsts")}
    halves = by(analysis.halves_test(p, tests, n_boot=200), "test_id")
    assert halves["short"]["method"] == "skipped" and halves["short"]["is_passed"] and halves["long"]["method"] == "ascm"


def test_ensemble_follows_the_scoring_rule(spark):
    cols = "test_id string, method string, absolute_lift double, relative_lift double, lift_lower_ci double, lift_upper_ci double, p_value double, is_significant boolean, cohen_d double, lift_likelihood double, l2_imbalance double, r_squared double"
    rows = [("t", "ascm", 10.0, 0.1, 0.05, 0.15, 0.01, True, 1.0, 0.99, 0.02, 0.9), ("t", "did", 20.0, 0.2, -0.05, 0.3, 0.2, False, 0.5, 0.8, 0.0, 0.0)]
    r = spark.createDataFrame(rows, cols)
    w = {k: v["weight"] for k, v in by(causal.ensemble_weights(r), "method").items()}
    raw = {"ascm": 2.0 * (0.5 * 0.8 + 0.5 * 0.9 + 0.1), "did": 0.5 * 0.6}
    assert w == pytest.approx({k: v / sum(raw.values()) for k, v in raw.items()})
    e = one(causal.weighted_ensemble(r))
    assert e["p_value"] == 0.2 and not e["is_significant"] and e["lift_lower_ci"] == -0.05 and e["l2_imbalance"] == 0.02
    a = one(validation.estimator_agreement(r))["agreement"]
    assert a == pytest.approx(0.4 + 0.3 * (1 - 0.05 / 0.15) + 0.15)


def test_incremental_revenue_near_zero_lift(spark):
    res = spark.createDataFrame([("t", 1e-9, 1e-9, -0.1, 0.1)], "test_id string, absolute_lift double, relative_lift double, lift_lower_ci double, lift_upper_ci double")
    scale = spark.createDataFrame([("t", 10, 28)], "test_id string, n_treatment int, n_days int")
    r = one(returns.incremental_revenue(res, scale))
    assert r["incremental_lower"] == r["incremental_upper"] == r["incremental_revenue"]


def test_winsorising_pulls_an_outlier_in_and_ignores_small_tests(spark, make_panel):
    p = make_panel().withColumn("revenue", F.when(F.col("geo") == "g00", F.col("revenue") * 10).otherwise(F.col("revenue")))
    mean = lambda df: df.filter("geo = 'g00'").agg(F.avg("revenue")).first()[0]
    assert mean(quality.winsorise(p, low=0.05, high=0.95)) < mean(p)
    few = p.filter("geo IN ('g00', 'g01', 'g02')")
    assert mean(quality.winsorise(few)) == pytest.approx(mean(few))


def test_anomaly_report_findings(spark):
    rows = panel_rows()
    rows = [r for r in rows if not (r[1] == "g00" and r[3] > day(20))]
    rows = [(*r[:4], 0.0 if r[1] == "g01" else r[4], *r[5:]) for r in rows]
    rows = [(*r[:4], 50000.0 if r[1] == "g02" and r[3] == day(7) else r[4], *r[5:]) for r in rows]
    p = spark.createDataFrame(rows, PANEL_SCHEMA)
    cells = spark.createDataFrame(panel_rows(), PANEL_SCHEMA).select("test_id", "geo", "cell").distinct()
    extra = spark.createDataFrame([("ghost", "x", "holdout")], "test_id string, geo string, cell string")
    found = {(r["test_id"], r["category"]): r for r in quality.anomaly_report(p, cells.unionByName(extra)).collect()}
    assert found[("t", "missing_data")]["affected_geos"] == ["g00"]
    assert "g02" in found[("t", "outlier")]["affected_geos"]
    assert found[("t", "zero_revenue")]["affected_geos"] == ["g01"]
    assert found[("t", "coverage")]["details"]["missing_treatment_post"] == "1"
    assert found[("ghost", "coverage")]["severity"] == "blocker"


def test_fill_goes_forward_then_back_then_zero(spark):
    rows = []
    for d in range(4):
        rows.append(("t", "T", "treatment", day(d), 1.0, 0, "pre"))
        rows.append(("t", "T", "treatment", day(10 + d), 1.0, 0, "post"))
        rows.append(("t", "H", "holdout", day(10 + d), 9.0, 0, "post"))
        rows.append(("t", "K", "holdout", day(d), 3.0, 0, "pre"))
    rows += [("t", "H", "holdout", day(1), 5.0, 0, "pre"), ("t", "H", "holdout", day(2), 6.0, 0, "pre"), ("t", "K", "holdout", day(10), 4.0, 0, "post")]
    f = P.fill_donor_grid(spark.createDataFrame(rows, PANEL_SCHEMA))
    pre = [r["y"] for r in f.filter("unit = 'H' AND period = 'pre'").orderBy("date").collect()]
    assert pre == [5.0, 5.0, 6.0, 6.0]


def test_full_analysis_reports_every_test(spark):
    days = []
    rng = random.Random(3)
    for g in range(16):
        for d in range(80):
            v = 1000 * (1 + 0.1 * (g % 5)) * (1 + 0.03 * rng.uniform(-1, 1)) * (1.12 if g < 10 and d >= 60 else 1.0)
            days.append((day(d), f"g{g:02d}", v, 10 + (g < 10 and d >= 60)))
    daily = spark.createDataFrame(days, "date date, geo string, revenue double, orders int").withColumn("store", F.col("revenue") * 0.75).withColumn("marketplace", F.col("revenue") * 0.25)
    tests = spark.createDataFrame([("a", day(60), day(79), 60), ("b", day(60), day(79), 40)], "test_id string, start_date date, end_date date, lookback_days int")
    cells = spark.createDataFrame([(t, f"g{g:02d}", "treatment" if g < 10 else "holdout") for t in "ab" for g in range(16)], "test_id string, geo string, cell string")
    spend = spark.createDataFrame([(day(d), f"g{g:02d}", 50.0) for d in range(60, 80) for g in range(10)], "date date, geo string, spend double")
    edges = spark.createDataFrame([("g00", "g10")], "src string, dst string")
    out = by(analysis.analyse_tests(daily, tests, cells, spend, edges, n_boot=200, platforms=("store", "marketplace")), "test_id")
    assert set(out) == {"a", "b"}
    for r in out.values():
        assert r["relative_lift"] == pytest.approx(0.12 / (1 - 0.2 / 6), abs=0.03)
        assert r["recommendations"][0] == "not_significant" and r["recommendations"][2] == "halo_significant"
        assert {k: v["relative_lift"] for k, v in r["platform_lifts"].items()} == pytest.approx({"store": 0.12, "marketplace": 0.12}, abs=0.03)
        assert r["total_spend"] == 10000.0 and r["iroas"] > 1 and r["cpia"] > 0 and r["n_methods"] == 3
