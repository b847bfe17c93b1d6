"""Variance components, detectable effects and back-tested power."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.hashing import hash32
from liftfield.functions.scalars import monday_week, clamp
from liftfield.functions.stats import normal_cdf, normal_quantile, student_t_two_sided_p
from liftfield.operators.causal import pooled_t
from liftfield.session import cut_lineage

EFFECTS = (0.05, 0.10, 0.15, 0.20)


# ---- variance components --------------------------------------------------------------------


def weekly_totals(daily: DataFrame, keys: list[str], value: str = "revenue") -> DataFrame:
    return daily.groupBy(*keys, "geo", monday_week(F.col("date")).alias("week")).agg(F.sum(value).alias("y"))


def lag_correlations(weekly: DataFrame, keys: list[str]) -> DataFrame:
    """Lag-1 correlation of each market's weeks (4 weeks or more, some spread)."""
    w = W.Window.partitionBy(*keys, "geo").orderBy("week")
    pairs = weekly.withColumn("before", F.lag("y").over(w))
    sd = lambda c: F.stddev_pop(F.when(F.col("before").isNotNull(), F.col(c)))
    agg = pairs.groupBy(*keys, "geo").agg(
        F.count("*").alias("n"), sd("y").alias("s1"), sd("before").alias("s0"), F.covar_pop("y", "before").alias("c"))
    return agg.filter("n >= 4 AND s1 > 0 AND s0 > 0").select(*keys, "geo", (F.col("c") / (F.col("s1") * F.col("s0"))).alias("rho"))


def variance_components(daily: DataFrame, keys: list[str] = ["test_id"], value: str = "revenue") -> DataFrame:
    """Within- and between-market variance of weekly revenue, means, CV and mean autocorrelation per key."""
    weekly = cut_lineage(weekly_totals(daily, keys, value))
    by_geo = weekly.groupBy(*keys, "geo").agg(F.var_samp("y").alias("v"), F.avg("y").alias("m"), F.count("*").alias("n"))
    agg = by_geo.groupBy(*keys).agg(
        F.avg("v").alias("within_var"), F.var_samp("m").alias("raw_between"), F.avg("n").alias("avg_n"),
        F.avg("m").alias("mean_weekly"), F.count("*").alias("n_geos"))
    periods = weekly.groupBy(*keys).agg(F.count_distinct("week").alias("n_periods"))
    rho = lag_correlations(weekly, keys).groupBy(*keys).agg(F.avg("rho").alias("rho"))
    day_mean = daily.groupBy(*keys, "geo").agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.avg("m").alias("mean_daily"))
    between = F.greatest(F.lit(0.0), F.col("raw_between") - F.col("within_var") / F.greatest("avg_n", F.lit(1.0)))
    out = agg.withColumn("between_var", between).withColumn("total_var", F.col("between_var") + F.col("within_var"))
    cv = F.when(F.col("mean_weekly") > 0, F.sqrt("total_var") / F.col("mean_weekly")).otherwise(F.lit(float("inf")))
    return cut_lineage(out.withColumn("cv", cv).join(periods, keys).join(day_mean, keys).join(rho, keys, "left").select(
        *keys, "between_var", "within_var", "total_var", "mean_daily", "mean_weekly", "cv", "n_geos", "n_periods",
        F.coalesce("rho", F.lit(0.0)).alias("rho")))


# ---- closed forms ---------------------------------------------------------------------------


def effective_weeks(weeks: Column) -> Column:
    rho = F.col("rho")
    return F.greatest(F.when(rho > 0, weeks * (1 - rho) / (1 + rho)).otherwise(weeks.cast("double")), F.lit(1.0))


def effect_se(n_t: Column, n_h: Column, weeks: Column) -> Column:
    v = F.col("within_var") / effective_weeks(weeks)
    return F.sqrt(v / n_t + v / n_h)


def detectable_effect(n_t: Column, n_h: Column, weeks: Column, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Smallest detectable lift, relative to mean weekly revenue, from variance-component columns."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return F.when(F.col("mean_weekly") > 0, z * effect_se(n_t, n_h, weeks) / F.col("mean_weekly")).otherwise(F.lit(float("inf")))


def achieved_power(effect: Column, n_t: Column, n_h: Column, weeks: Column, alpha: float = 0.05) -> Column:
    """Two-sided power for an effect."""
    z = normal_quantile(1 - alpha / 2)
    se = effect_se(n_t, n_h, weeks)
    shift = F.when(se > 0, effect * F.col("mean_weekly") / se).otherwise(0.0)
    return F.least(1 - normal_cdf(z - shift) + normal_cdf(-z - shift), F.lit(1.0))


def weeks_grid(rows: DataFrame, first: int, last: int) -> DataFrame:
    return rows.withColumn("weeks", F.explode(F.sequence(F.lit(first), F.lit(last))))


def mde_grid(variance: DataFrame, n_t: str = "n_treatment", n_h: str = "n_holdout", last: int = 12, alpha: float = 0.05, power: float = 0.80) -> DataFrame:
    """Detectable effect and its power for every duration."""
    g = weeks_grid(variance, 1, last)
    g = g.withColumn("mde", detectable_effect(F.col(n_t), F.col(n_h), F.col("weeks"), alpha, power))
    return g.withColumn("power", achieved_power(F.col("mde"), F.col(n_t), F.col(n_h), F.col("weeks"), alpha))


def required_duration(variance: DataFrame, keys: list[str], target: float, max_weeks: int = 12, alpha: float = 0.05, power: float = 0.80) -> DataFrame:
    """First duration whose detectable effect meets the target, else the longest."""
    g = mde_grid(variance, last=max_weeks, alpha=alpha, power=power)
    return g.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("mde") <= target, F.col("weeks"))), F.lit(max_weeks)).alias("weeks"))


def power_result(
    variance: DataFrame, keys: list[str], target: float | None = None, min_weeks: int = 2, max_weeks: int = 12,
    alpha: float = 0.05, power: float = 0.80, good_enough: float = 0.15,
) -> DataFrame:
    """Recommended duration, its detectable effect, power and effect size."""
    first = 1 if target is not None else min_weeks
    goal = target if target is not None else good_enough
    g = weeks_grid(variance, first, max_weeks).withColumn(
        "mde", detectable_effect(F.col("n_treatment"), F.col("n_holdout"), F.col("weeks"), alpha, power))
    hit = F.min(F.when(F.col("mde") <= goal, F.col("weeks")))
    fallback = F.lit(max_weeks) if target is not None else F.min_by("weeks", F.struct("mde", "weeks"))
    best = g.groupBy(*keys).agg(F.coalesce(hit, fallback).alias("duration_weeks"))
    rows = variance.join(best, keys)
    n_t, n_h, weeks = F.col("n_treatment"), F.col("n_holdout"), F.col("duration_weeks")
    rows = rows.withColumn("mde", detectable_effect(n_t, n_h, weeks, alpha, power))
    return rows.withColumn("power", achieved_power(F.col("mde"), n_t, n_h, weeks, alpha)).withColumn(
        "cohen_d", F.when(F.col("total_var") > 0, F.col("mde") * F.col("mean_weekly") / F.sqrt("total_var")).otherwise(0.0)
    ).withColumn("cell_size", F.greatest(n_t, n_h))


def duration_curve(power_rows: DataFrame, last: int = 12) -> DataFrame:
    """Detectable effect by duration scaled from the recommended one."""
    g = weeks_grid(power_rows, 1, last)
    return g.withColumn("curve_mde", F.col("mde") * F.sqrt(F.col("duration_weeks") / F.col("weeks")))


# ---- scores ---------------------------------------------------------------------------------


def _mde_points(mde: Column) -> Column:
    return F.when(mde <= 0.10, 25.0).when(mde <= 0.15, 20.0).when(mde <= 0.20, 12.0).when(mde <= 0.30, 5.0).otherwise(0.0)


def _size_points(n: Column) -> Column:
    return F.when(n >= 20, 15.0).when(n >= 10, 10.0).when(n >= 5, 5.0).otherwise(0.0)


def _power_points(power: Column) -> Column:
    return F.when(power >= 0.80, 40.0).otherwise(40.0 * power / 0.80)


def power_score(power: Column, fpr: Column, mde: Column, n_holdout: Column) -> Column:
    """0–100: power 40, false-positive rate 20, detectable effect 25, holdout size 15."""
    calibration = F.when(fpr <= 0.06, 20.0).when(fpr <= 0.10, 15.0).when(fpr <= 0.15, 8.0).otherwise(0.0)
    return clamp(_power_points(power) + calibration + _mde_points(mde) + _size_points(n_holdout), 0, 100)


def analytical_power_score(power: Column, mde: Column, n_holdout: Column) -> Column:
    """Without a back-test the calibration part is a flat 15."""
    return clamp(_power_points(power) + 15.0 + _mde_points(mde) + _size_points(n_holdout), 0, 100)


# ---- back-test ------------------------------------------------------------------------------


def date_index(panel: DataFrame) -> DataFrame:
    """Distinct dates of each test numbered from 0, with their count."""
    w = W.Window.partitionBy("test_id")
    dates = panel.select("test_id", "date").distinct()
    return dates.withColumn("idx", F.row_number().over(w.orderBy("date")) - 1).withColumn("n_dates", F.count("*").over(w))


def prefix_sums(panel: DataFrame, value: str = "revenue") -> DataFrame:
    """Running sum and row count of each market over its test's dates, so any window's mean is two lookups."""
    dates = date_index(panel)
    markets = panel.select("test_id", "geo", "cell").distinct()
    day = panel.groupBy("test_id", "geo", "date").agg(F.sum(value).alias("y"), F.count(value).alias("c"))
    grid = markets.join(dates.select("test_id", "date", "idx"), "test_id").join(day, ["test_id", "geo", "date"], "left")
    w = W.Window.partitionBy("test_id", "geo").orderBy("idx").rowsBetween(W.Window.unboundedPreceding, 0)
    return grid.select(
        "test_id", "geo", "cell", "idx",
        F.sum(F.coalesce("y", F.lit(0.0))).over(w).alias("s"), F.sum(F.coalesce("c", F.lit(0))).over(w).alias("n"))


def backtest_bounds(panel: DataFrame, post_days: int | DataFrame) -> DataFrame:
    """First and last usable split position per test; tests with too short a history are left out.

    ``post_days`` is one length for all tests, or (test_id, post_days) with a length for each, carried along as a column.
    """
    n = date_index(panel).groupBy("test_id").agg(F.max("n_dates").cast("int").alias("n_dates"))
    own = isinstance(post_days, DataFrame)
    n = n.join(post_days.select("test_id", F.col("post_days").cast("int").alias("post_days")), "test_id") if own else n
    days = F.col("post_days") if own else F.lit(post_days)
    enough = n.filter(F.col("n_dates") >= days + 14)
    low = F.greatest(F.lit(14), F.col("n_dates") - 3 * days)
    high = F.col("n_dates") - days
    low = F.when(low > high, F.lit(14)).otherwise(low)
    return enough.withColumn("low", low).withColumn("high", F.when(high <= F.col("low"), F.col("low") + 1).otherwise(high))


def backtest_statistics(panel: DataFrame, post_days: int | DataFrame, effects=EFFECTS, value: str = "revenue") -> DataFrame:
    """t statistic of every (test, split position, injected effect), effect 0 included.

    Replicates only choose among these rows, so they never touch the panel. Tests of all lengths are one job: a split
    meets the running sums at its two ends, wherever those are.
    """
    bounds = backtest_bounds(panel, post_days)
    days = F.col("post_days") if isinstance(post_days, DataFrame) else F.lit(post_days)
    splits = bounds.select("test_id", "n_dates", F.explode(F.sequence("low", "high")).alias("split"), days.alias("days")).withColumn(
        "last", F.least(F.col("split") + F.col("days"), F.col("n_dates") - 1)).withColumn("before", F.col("split") - 1).drop("days")
    sums = cut_lineage(prefix_sums(panel, value))
    a = sums.select("test_id", "geo", "cell", F.col("idx").alias("before"), F.col("s").alias("s0"), F.col("n").alias("n0"))
    b = sums.select("test_id", "geo", F.col("idx").alias("last"), F.col("s").alias("s1"), F.col("n").alias("n1"))
    rows = splits.join(a, ["test_id", "before"]).join(b, ["test_id", "last", "geo"])
    grid = rows.withColumn("effect", F.explode(F.array(*[F.lit(float(e)) for e in (0.0, *effects)])))
    post = F.when(F.col("n1") > F.col("n0"), (F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0")))
    lifted = post * (1 + F.when(F.col("cell") == "treatment", F.col("effect")).otherwise(0.0))
    changes = grid.withColumn("pre_mean", F.when(F.col("n0") > 0, F.col("s0") / F.col("n0"))).withColumn("post_mean", lifted)
    changes = changes.withColumn("diff", F.col("post_mean") - F.col("pre_mean"))
    return pooled_t(changes, ["test_id", "split", "effect"])


def backtest_plan(bounds: DataFrame, n_sims: int = 200, effects=EFFECTS) -> DataFrame:
    """Which split each replicate of each effect uses; the null effect has min(n/2, 50) replicates."""
    n_null = min(n_sims // 2, 50)
    arms = F.array(*[F.struct(F.lit(float(e)).alias("effect"), F.lit(n).alias("n_rep"), F.lit(i).alias("arm"))
                     for i, (e, n) in enumerate([(0.0, n_null), *[(e, n_sims) for e in effects]])])
    rows = bounds.withColumn("a", F.explode(arms)).select("test_id", "low", "high", "a.*").filter("n_rep > 0")
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.col("n_rep") - 1)))
    split = F.col("low") + hash32(F.col("test_id"), F.col("arm"), F.col("rep")) % (F.col("high") + 1 - F.col("low"))
    return rows.select("test_id", "effect", "rep", split.cast("int").alias("split"))


def backtest_power(panel: DataFrame, post_days: int | DataFrame, n_sims: int = 200, alpha: float = 0.05, effects=EFFECTS, value: str = "revenue") -> DataFrame:
    """Per test and effect: share of replicates that detect it (effect 0 = false-positive rate)."""
    stats = backtest_statistics(panel, post_days, effects, value)
    p = F.coalesce(student_t_two_sided_p(F.col("t_stat"), F.col("dof").cast("double")), F.lit(1.0))
    found = stats.withColumn("p_value", p)
    plan = backtest_plan(backtest_bounds(panel, post_days), n_sims, effects)
    hits = plan.join(found, ["test_id", "effect", "split"], "left")
    return hits.groupBy("test_id", "effect").agg(
        F.count("*").alias("n_sims"), F.avg(F.coalesce(F.col("p_value") < alpha, F.lit(False)).cast("double")).alias("detected"))


def backtest_summary(power_rows: DataFrame, sizes: DataFrame, effects=EFFECTS) -> DataFrame:
    """Smallest effect with 80 % power (largest one if none), its power, the false-positive rate and the score."""
    top = float(max(effects))
    real = F.col("effect") > 0
    agg = power_rows.groupBy("test_id").agg(
        F.min(F.when(real & (F.col("detected") >= 0.80), F.col("effect"))).alias("hit"),
        F.max(F.when(F.col("effect") == 0, F.col("detected"))).alias("fpr"),
        F.map_from_entries(F.collect_list(F.struct("effect", "detected"))).alias("by_effect"))
    rows = agg.withColumn("mde", F.coalesce("hit", F.lit(top))).withColumn("sim_power", F.col("by_effect")[F.col("mde")])
    rows = rows.join(sizes, "test_id")
    return rows.select(
        "test_id", "mde", "sim_power", F.coalesce("fpr", F.lit(0.0)).alias("fpr"),
        power_score(F.col("sim_power"), F.coalesce("fpr", F.lit(0.0)), F.col("mde"), F.col("n_holdout")).alias("power_score"))
