"""Release gates of a media-mix run and placebo checks on the outcome panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.hashing import hash32
from liftfield.functions.scalars import banded, clamp
from liftfield.operators.power import date_index
from liftfield.session import small_side, spread

# Gate thresholds.
MAPE_LIMITS = {"shopify": 0.10, "amazon": 0.15}
RATIO_BANDS = {"shopify": (0.95, 1.05), "amazon": (0.93, 1.07)}
RHAT_LIMIT = 1.05
LIFT_LIMIT = 0.25
BETA_CV_LIMIT = 0.50
GAP_LIMIT = 0.40


def _reasons(rules):
    return F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))


def gate_fit(facts: DataFrame) -> DataFrame:
    """Gate 1 from mape_shopify, mape_amazon, ratio_shopify, ratio_amazon, rhat_max: pass flags, blockers, warnings."""
    within = lambda o: F.col(f"ratio_{o}").between(*RATIO_BANDS[o])
    rows = facts
    for o, limit in MAPE_LIMITS.items():
        rows = rows.withColumn(f"mape_{o}_ok", F.col(f"mape_{o}") < limit).withColumn(f"ratio_{o}_ok", within(o))
    rows = rows.withColumn("converged", F.col("rhat_max") < RHAT_LIMIT)
    rows = rows.withColumn("gate1_blockers", _reasons([
        (~F.col("mape_shopify_ok"), "mape_shopify"), (~F.col("mape_amazon_ok"), "mape_amazon"), (~F.col("ratio_shopify_ok"), "ratio_shopify"),
        (~F.col("converged"), "convergence")])).withColumn("gate1_warnings", _reasons([(~F.col("ratio_amazon_ok"), "ratio_amazon")]))
    return rows.withColumn("gate1_passed", F.size("gate1_blockers") == 0)


def lift_reconciliation(events: DataFrame, contributions: DataFrame) -> DataFrame:
    """Mean relative gap between measured lift and the model's contribution in the test window; 0 without pairs.

    Test windows become day rows, so the window join is a hash join on (channel, outcome, date).
    """
    days = events.select(
        "event_id", "channel", "outcome", "lift_abs", F.explode(F.sequence("test_start_date", "test_end_date")).alias("date"))
    daily = contributions.groupBy("channel", "outcome", "date").agg(F.sum("contribution_mean").alias("c"))
    model = days.join(daily, ["channel", "outcome", "date"]).groupBy("event_id").agg(
        F.sum("c").alias("model_lift"), F.first("lift_abs").alias("lift_abs"))
    gap = F.when(F.abs("lift_abs") > 1e-9, F.abs(F.col("model_lift") - F.col("lift_abs")) / F.abs("lift_abs"))
    return model.select(gap.alias("g")).agg(F.coalesce(F.avg("g"), F.lit(0.0)).alias("lift_gap"), F.count("g").alias("n_events"))


def curves_monotone(curves: DataFrame) -> DataFrame:
    """Whether every (channel, outcome) curve never falls."""
    w = W.Window.partitionBy("channel", "outcome").orderBy("spend")
    steps = curves.withColumn("d", F.col("revenue") - F.lag("revenue").over(w))
    return steps.groupBy("channel", "outcome").agg((F.coalesce(F.min("d"), F.lit(0.0)) >= -1e-9).alias("is_monotone"))


def gate_causal(facts: DataFrame) -> DataFrame:
    """Gate 2 from lift_gap, is_monotone, beta_first, beta_second (the first should exceed the second)."""
    rows = facts.withColumn("lift_ok", F.col("lift_gap") < LIFT_LIMIT).withColumn("order_ok", F.col("beta_first") > F.col("beta_second"))
    return rows.withColumn("gate2_blockers", _reasons([(~F.col("lift_ok"), "lift")])).withColumn(
        "gate2_warnings", _reasons([(~F.col("is_monotone"), "monotone"), (~F.col("order_ok"), "beta_order")])
    ).withColumn("gate2_passed", F.col("lift_ok"))


def gate_attribution(gaps: DataFrame, cvs: DataFrame) -> DataFrame:
    """Gate 3, informational: largest attribution gap, channels above 40 %, largest effect CV."""
    g = gaps.agg(F.coalesce(F.max(F.abs("delta")), F.lit(0.0)).alias("gap_max"), F.count_if(F.abs("delta") > GAP_LIMIT).alias("n_large_gaps"), F.lit(1).alias("_k"))
    c = cvs.agg(F.coalesce(F.max("cv"), F.lit(0.0)).alias("cv_max"), F.lit(1).alias("_k"))
    return g.join(c, "_k").drop("_k").withColumn("beta_plausible", F.col("cv_max") < BETA_CV_LIMIT)


def gate_score(facts: DataFrame) -> DataFrame:
    """0–100 over all three gates and its band; a near miss earns part of the points."""
    c = F.col
    tier = lambda ok, full, near, part: F.when(ok, full).when(near, part).otherwise(0)
    both, either = c("ratio_shopify_ok") & c("ratio_amazon_ok"), c("ratio_shopify_ok") | c("ratio_amazon_ok")
    score = (
        tier(c("mape_shopify_ok"), 15, c("mape_shopify") < MAPE_LIMITS["shopify"] * 1.5, 7)
        + tier(c("mape_amazon_ok"), 10, c("mape_amazon") < MAPE_LIMITS["amazon"] * 1.5, 5)
        + tier(c("converged"), 20, c("rhat_max") < 1.10, 10)
        + tier(both, 5, either, 2)
        + tier(c("lift_ok"), 25, c("lift_gap") < LIFT_LIMIT * 1.5, 12)
        + F.when(c("is_monotone"), 10).otherwise(0) + F.when(c("order_ok"), 5).otherwise(0)
        + tier(c("gap_max") < 0.40, 5, c("gap_max") < 0.60, 2) + F.when(c("beta_plausible"), 5).otherwise(0)
    )
    rows = facts.withColumn("trust_score", clamp(score.cast("double"), 0, 100))
    label = banded(F.col("trust_score"), [(60, "Insufficient"), (75, "Marginal"), (90, "Good")], "Excellent")
    return rows.withColumn("trust_label", label).withColumn("all_passed", c("gate1_passed") & c("gate2_passed"))


def production_gates(facts: DataFrame) -> DataFrame:
    """Hard failures and warnings from national_mape, geo_median_mape, ci_ratio, paid_share, baseline_share, rhat_max, min_ess, n_divergences."""
    c = F.col
    hard = _reasons([
        (c("national_mape") > 0.15, "national_mape"), (c("geo_median_mape") > 0.25, "geo_mape"), (~c("paid_share").between(0.30, 0.70), "paid_share"),
        (c("rhat_max") >= 1.05, "rhat"), (c("min_ess") < 400, "ess"), (c("n_divergences") > 50, "divergences")])
    soft = _reasons([(c("ci_ratio") > 3.0, "ci_ratio"), (~c("baseline_share").between(0.30, 0.60), "baseline_share")])
    return facts.withColumn("failures", hard).withColumn("warnings", soft).withColumn("is_passed", F.size("failures") == 0)


# ---- placebo checks on an outcome panel (test_id, date, geo, value) -------------------------

EFFECT_LIMIT = 0.10
PASS_TARGET = 0.80


def _date_means(panel: DataFrame) -> DataFrame:
    idx = date_index(panel)
    day = panel.groupBy("test_id", "date").agg(F.avg("value").alias("v"))
    return day.join(idx, ["test_id", "date"])


def placebo_halves(panel: DataFrame, n_boot: int = 500) -> DataFrame:
    """First against second half of the dates: relative change, bootstrap interval and p; passes below 10 %."""
    days = _date_means(panel).withColumn("mid", F.floor(F.col("n_dates") / 2)).filter("n_dates >= 4")
    days = days.withColumn("half", (F.col("idx") >= F.col("mid")).cast("int"))
    obs = days.groupBy("test_id").agg(
        F.avg(F.when(F.col("half") == 0, F.col("v"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("b"))
    obs = obs.filter(F.abs("a") >= 1e-9).select("test_id", ((F.col("b") - F.col("a")) / F.abs("a")).alias("effect"))
    items = days.select("test_id", "half", (F.col("idx") - F.col("half") * F.col("mid")).cast("int").alias("pick"), "v")
    sizes = items.groupBy("test_id", "half").agg(F.count("*").alias("n"))
    reps = spread(sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))), "test_id", "rep")
    slots = reps.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    plan = slots.withColumn("pick", (hash32(F.col("test_id"), F.col("rep"), F.col("half"), F.col("slot")) % F.col("n")).cast("int"))
    boot = plan.join(small_side(items), ["test_id", "half", "pick"]).groupBy("test_id", "rep").agg(
        F.avg(F.when(F.col("half") == 0, F.col("v"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("b"))
    e = F.when(F.abs("a") > 1e-9, (F.col("b") - F.col("a")) / F.abs("a"))
    by = boot.select("test_id", e.alias("e")).groupBy("test_id").agg(
        F.percentile("e", 0.05).alias("ci_low"), F.percentile("e", 0.95).alias("ci_high"),
        (2 * F.least(F.avg((F.col("e") >= 0).cast("double")), F.avg((F.col("e") <= 0).cast("double")))).alias("p_value"))
    return obs.join(by, "test_id").withColumn("is_passed", F.abs("effect") < EFFECT_LIMIT)


def placebo_splits(panel: DataFrame, n_splits: int = 3, low: float = 0.20, high: float = 0.65) -> DataFrame:
    """Change at made-up split dates: everything before against a window after; passes below 15 %."""
    days = _date_means(panel).filter(F.col("n_dates") >= (n_splits + 1) * 4)
    fracs = [low + (high - low) * i / (n_splits - 1) for i in range(n_splits)]
    at = F.array(*[F.struct(F.lit(i).alias("split"), F.floor(F.col("n_dates") * F.lit(f)).alias("at")) for i, f in enumerate(fracs)])
    span = F.greatest(F.floor(F.col("n_dates") / (n_splits + 1)), F.lit(2))
    rows = days.withColumn("s", F.explode(at)).select("test_id", "idx", "v", "s.split", "s.at", span.alias("span"))
    by = rows.groupBy("test_id", "split").agg(
        F.avg(F.when(F.col("idx") < F.col("at"), F.col("v"))).alias("a"),
        F.avg(F.when((F.col("idx") >= F.col("at")) & (F.col("idx") < F.col("at") + F.col("span")), F.col("v"))).alias("b"))
    effect = F.when(F.abs("a") >= 1e-9, (F.col("b") - F.col("a")) / F.abs("a"))
    return by.filter("a IS NOT NULL AND b IS NOT NULL").select(
        "test_id", "split", effect.alias("effect"), F.coalesce(F.abs(effect) < EFFECT_LIMIT * 1.5, F.lit(True)).alias("is_passed"))


def placebo_markets(panel: DataFrame) -> DataFrame:
    """Each of the last quarter of markets against the mean of all others, second minus first half; passes below 20 %.

    The mean of the others is the date total less the market's own value, so no market meets any other.
    """
    idx = date_index(panel).select("test_id", "date", (F.col("idx") >= F.floor(F.col("n_dates") / 2)).cast("int").alias("half"))
    order = W.Window.partitionBy("test_id").orderBy("geo")
    markets = panel.select("test_id", "geo").distinct().withColumn("i", F.row_number().over(order) - 1).withColumn(
        "g", F.count("*").over(W.Window.partitionBy("test_id"))).filter("g >= 4")
    held = markets.filter(F.col("i") >= F.floor(F.col("g") * 0.75)).select("test_id", "geo")
    totals = panel.groupBy("test_id", "date").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    rows = panel.join(held, ["test_id", "geo"]).join(totals, ["test_id", "date"]).join(idx, ["test_id", "date"])
    rows = rows.withColumn("other", F.when(F.col("n") > 1, (F.col("s") - F.col("value")) / (F.col("n") - 1)))
    half = lambda c, h: F.avg(F.when(F.col("half") == h, F.col(c)))
    by = rows.groupBy("test_id", "geo").agg(
        half("value", 0).alias("t0"), half("value", 1).alias("t1"), half("other", 0).alias("c0"), half("other", 1).alias("c1"))
    effect = ((F.col("t1") - F.col("c1")) - (F.col("t0") - F.col("c0"))) / F.greatest(F.abs("t0"), F.lit(1.0))
    return by.select("test_id", "geo", effect.alias("effect"), (F.abs(effect) < EFFECT_LIMIT * 2).alias("is_passed"))


def placebo_report(halves: DataFrame, splits: DataFrame, markets: DataFrame) -> DataFrame:
    """Pass rates, overall verdict and 5 bonus points per passed part."""
    rate = lambda df, n: df.groupBy("test_id").agg(F.avg(F.col("is_passed").cast("double")).alias(n))
    rows = halves.select("test_id", F.col("is_passed").alias("halves_passed")).join(rate(splits, "split_rate"), "test_id", "left").join(
        rate(markets, "market_rate"), "test_id", "left").fillna(1.0, ["split_rate", "market_rate"])
    parts = [F.col("halves_passed"), F.col("split_rate") >= PASS_TARGET, F.col("market_rate") >= PASS_TARGET]
    bonus = sum((F.when(p, 5).otherwise(0) for p in parts), F.lit(0))
    return rows.withColumn("bonus", bonus).withColumn("is_passed", parts[0] & parts[1] & parts[2])
