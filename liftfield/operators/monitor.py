"""Monitoring: drops, decay, rolling error, rankings, waterfalls, plan tables and alert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.scalars import banded
from liftfield.operators.latest import first_per_key, latest_per_key
from liftfield.operators.ranks import running_counts
from liftfield.session import small_side, with_grand

ALERT_COLUMNS = ("rule", "severity", "subject", "at", "value", "threshold")


# ---- window measures ------------------------------------------------------------------------


def weekly_drops(weekly: DataFrame, keys: list[str], value: str, threshold_pct: float, positive_only: bool = False) -> DataFrame:
    """Drop of each week against the one before, and whether it exceeds the threshold.

    No previous week, a zero one (or, if asked, a negative one) never alerts.
    """
    w = W.Window.partitionBy(*keys).orderBy("week")
    before = F.lag(value).over(w)
    rows = weekly.withColumn("previous", before)
    usable = F.col("previous") > 0 if positive_only else F.col("previous") != 0
    drop = F.when(usable, (F.col("previous") - F.col(value)) / F.abs("previous") * 100)
    return rows.withColumn("drop_pct", drop).withColumn("is_alert", F.coalesce(F.col("drop_pct") > threshold_pct, F.lit(False))).withColumn(
        "threshold", F.lit(float(threshold_pct)))


def beta_decay(betas: DataFrame, threshold_pct: float = 25.0, points: int = 13, value: str = "beta_mean") -> DataFrame:
    """Current effect against its mean over the last ``points`` rows."""
    w = W.Window.partitionBy("channel").orderBy("date").rowsBetween(-(points - 1), 0)
    rows = betas.withColumn("trailing_mean", F.avg(value).over(w))
    drop = F.when(F.col("trailing_mean") != 0, (F.col("trailing_mean") - F.col(value)) / F.abs("trailing_mean") * 100)
    return rows.withColumn("drop_pct", drop).withColumn("is_alert", F.coalesce(F.col("drop_pct") > threshold_pct, F.lit(False))).withColumn(
        "threshold", F.lit(float(threshold_pct)))


def rolling_error(errors: DataFrame, threshold: float = 0.12, days: int = 7) -> DataFrame:
    """Mean absolute percentage error over the trailing ``days`` calendar days and the refit flag.

    ``errors`` has date, actual, predicted; days are averaged from daily sums, so the window sees one row a day.
    """
    ape = F.abs(F.col("actual") - F.col("predicted")) / (F.abs("actual") + 1e-8)
    day = errors.groupBy("date").agg(F.sum(ape).alias("s"), F.count("*").alias("n")).withColumn("d", F.datediff("date", F.lit("1970-01-01").cast("date")))
    # the calendar is cut into blocks so that a long history is not one window partition: each day is copied
    # into every block whose windows may need it
    block = 512
    home = F.floor(F.col("d") / block)
    copies = day.withColumn("home", home).withColumn("block", F.explode(F.array_distinct(F.array(home, F.floor((F.col("d") + days - 1) / block)))))
    w = W.Window.partitionBy("block").orderBy("d").rangeBetween(-(days - 1), 0)
    rolled = copies.withColumn("mape", F.sum("s").over(w) / F.sum("n").over(w)).filter("home = block")
    return rolled.select("date", "mape", (F.col("mape") > threshold).alias("needs_refit"), F.lit(threshold * 100.0).alias("threshold"))


def average_rank(df: DataFrame, value: str, keys: list[str] = []) -> DataFrame:
    """Descending rank, ties share their mean rank truncated to a whole number.

    Counted from distinct values with their multiplicities, in parts of the order; no task holds a key.
    """
    counts = running_counts(df, keys, value, descending=True)
    ranks = counts.select(*keys, value, F.floor(F.col("before") + (F.col("n") + 1) / 2).cast("bigint").alias("rank"))
    return df.join(ranks, [*keys, value])


def top_ranked(ranked: DataFrame, n: int = 20, bottom: bool = False) -> DataFrame:
    """First or last ``n`` markets by rank, market code breaking ties."""
    order = [F.col("rank").desc(), F.col("geo").desc()] if bottom else [F.col("rank"), F.col("geo")]
    return ranked.orderBy(*order).limit(n)


def waterfall(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Running total from the baseline through the channels to the residual, with a closing total row.

    ``parts`` has keys, position, label, value.
    """
    w = W.Window.partitionBy(*keys).orderBy("position", "label").rowsBetween(W.Window.unboundedPreceding, 0)
    steps = parts.select(*keys, "position", "label", "value", F.sum("value").over(w).alias("cumulative"))
    total = parts.groupBy(*keys).agg((F.max("position") + 1).alias("position"), F.sum("value").alias("value"))
    return steps.unionByName(total.select(*keys, "position", F.lit("total").alias("label"), "value", F.col("value").alias("cumulative")))


# ---- error and convergence aggregates -------------------------------------------------------


def mape(rows: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted", eps: float = 1e-8) -> DataFrame:
    e = F.abs(F.col(actual) - F.col(predicted)) / (F.abs(F.col(actual)) + eps)
    return rows.groupBy(*keys).agg(F.avg(e).alias("mape"))


def contribution_ratio(parts: DataFrame, actual: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """Σ contributions / Σ actual per key and whether it lies within the tolerance of 1; 0 without revenue."""
    a = parts.groupBy(*keys).agg(F.sum("contribution").alias("c"))
    b = actual.groupBy(*keys).agg(F.sum("revenue").alias("r"))
    ratio = F.when(F.abs("r") > 1e-9, F.coalesce("c", F.lit(0.0)) / F.col("r")).otherwise(0.0)
    return b.join(a, keys, "left").select(*keys, ratio.alias("ratio"), (F.abs(ratio - 1.0) <= tolerance).alias("is_within"))


def rhat_summary(rhats: DataFrame, threshold: float = 1.05) -> DataFrame:
    return rhats.agg(
        F.max("rhat").alias("rhat_max"), F.avg("rhat").alias("rhat_mean"), F.count_if(F.col("rhat") > threshold).alias("n_high"),
        F.max_by("parameter", F.struct("rhat", "parameter")).alias("worst_parameter"))


def beta_cv(betas: DataFrame, value: str = "beta_mean") -> DataFrame:
    """Population CV of each channel's effect over time; channels with a ~0 mean have none."""
    agg = betas.groupBy("channel").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return agg.select("channel", F.when(F.abs("m") > 1e-9, F.col("s") / F.abs("m")).alias("cv"))


def status_shares(df: DataFrame, column: str) -> DataFrame:
    by = df.groupBy(column).agg(F.count("*").alias("n"))
    return with_grand(by, _t=F.sum("n")).select(column, "n", (F.col("n") / F.col("_t")).alias("share"))


# ---- comparisons ----------------------------------------------------------------------------


def model_vs_test(results: DataFrame, tests: DataFrame, outcome: str = "shopify") -> DataFrame:
    """Model return next to the tested iROAS: delta = (model − test) / test, absent without a usable test."""
    rows = results.filter(F.col("outcome") == outcome).join(tests.select("channel", F.col("iroas").alias("test_iroas")), "channel", "left")
    ok = (F.col("test_iroas") != 0) & (F.col("roi_mean") > 0)
    return rows.select("channel", "roi_mean", "test_iroas", F.when(ok, (F.col("roi_mean") - F.col("test_iroas")) / F.col("test_iroas")).alias("delta"))


def attribution_gap(mta: DataFrame, mmm: DataFrame, threshold: float = 0.40) -> DataFrame:
    """(model − attribution) / max(|a|, |m|, 1) over the channels of either side."""
    a = mta.select("channel", F.col("value").alias("mta"))
    b = mmm.select("channel", F.col("value").alias("mmm"))
    rows = a.join(b, "channel", "full").fillna(0.0, ["mta", "mmm"])
    base = F.greatest(F.abs("mta"), F.abs("mmm"), F.lit(1.0))
    return rows.select("channel", "mta", "mmm", ((F.col("mmm") - F.col("mta")) / base).alias("delta")).withColumn(
        "is_large", F.abs("delta") > threshold).withColumn("threshold", F.lit(threshold * 100.0))


LOWER_IS_BETTER = ("mape", "rhat", "diverged")


def compare_runs(metrics: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Metric by metric: both values, change, percentage and whether it is an improvement."""
    pick = lambda run: F.max(F.when(F.col("run_id") == run, F.col("value")))
    rows = metrics.filter(F.col("run_id").isin(run_a, run_b)).groupBy("metric").agg(pick(run_a).alias("value_a"), pick(run_b).alias("value_b"))
    delta = F.col("value_b") - F.col("value_a")
    lower = None
    for word in LOWER_IS_BETTER:
        hit = F.contains(F.col("metric"), F.lit(word))
        lower = hit if lower is None else lower | hit
    return rows.select(
        "metric", "value_a", "value_b", delta.alias("delta"),
        F.when(F.abs("value_a") > 1e-9, delta / F.abs("value_a") * 100).alias("delta_pct"),
        F.when(delta.isNotNull(), F.when(lower, delta < 0).otherwise(delta > 0)).alias("is_improved"))


def metric_rows(wide: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Numeric and boolean columns of a result as (key, metric, value) rows; booleans become 0/1."""
    cols = [c for c, t in wide.dtypes if c != key and t in ("double", "float", "int", "bigint", "boolean")]
    typed = wide.select(key, *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in cols])
    return typed.unpivot(key, [f"{prefix}{c}" for c in cols], "metric", "value")


def saturation_table(spend: DataFrame, curves: DataFrame, keys: list[str] = ["channel"]) -> DataFrame:
    """Spend over the curve's half-saturation point, its class and the change that would close the gap."""
    rows = spend.join(small_side(curves.select(*keys, F.col("gamma").alias("inflection"))), keys)
    ratio = F.col("spend") / F.col("inflection")
    return rows.withColumn("ratio", ratio).withColumn(
        "status", banded(F.col("ratio"), [(0.6, "Under-Invested"), (1.3, "Optimal")], "Saturated")).withColumn(
        "recommended_change", F.col("inflection") - F.col("spend"))


def decomposition(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline, channels and an empty residual per outcome with 80 and 95 % bands."""
    c = F.col("contribution_mean")
    channels = results.select(
        "outcome", F.lit(1).alias("position"), F.col("channel").alias("label"), c.alias("value"),
        F.col("contribution_p10").alias("low80"), F.col("contribution_p90").alias("high80"),
        F.col("contribution_p10").alias("low95"), F.col("contribution_p90").alias("high95"))
    v = F.col("value")
    base = baseline.select(
        "outcome", F.lit(0).alias("position"), F.lit("baseline").alias("label"), v, (v * 0.92).alias("low80"), (v * 1.08).alias("high80"),
        (v * 0.88).alias("low95"), (v * 1.12).alias("high95"))
    zero = F.lit(0.0)
    rest = baseline.select("outcome", F.lit(2).alias("position"), F.lit("residual").alias("label"), zero.alias("value"), zero.alias("low80"),
                           zero.alias("high80"), zero.alias("low95"), zero.alias("high95"))
    return base.unionByName(channels).unionByName(rest)


def calibration_staleness(events: DataFrame, as_of, max_age_days: int = 180) -> DataFrame:
    """Days since the last calibration of each channel."""
    last = events.groupBy("channel").agg(F.max("test_end_date").alias("last_end"), F.count("*").alias("n_events"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_end"))
    return last.select("channel", "last_end", "n_events", age.alias("age_days"), F.when(age > max_age_days, "stale").otherwise("current").alias("status"))


def latest_calibration(events: DataFrame) -> DataFrame:
    """Newest event per channel by end date, then ingestion order."""
    return latest_per_key(events, ["channel"], ["test_end_date", "ingested_seq"])


def model_constraints(events: DataFrame) -> DataFrame:
    """Accepted events in the model's vocabulary."""
    return events.select(
        "channel", "outcome", "lift_abs", F.col("lift_lower_90").alias("lift_lower"), F.col("lift_upper_90").alias("lift_upper"),
        "spend_in_period", F.date_format("test_start_date", "yyyy-MM-dd").alias("start_date"),
        F.date_format("test_end_date", "yyyy-MM-dd").alias("end_date"), "implied_roi", "test_type",
        *[c for c in ("geo_scope", "notes") if c in events.columns])


# ---- exclusion plans ------------------------------------------------------------------------


def exclusion_plan(adsets: DataFrame, assignment: DataFrame, managed: DataFrame | None = None) -> DataFrame:
    """(test, ad set, market) exclusions to add: holdout markets not yet excluded on ad sets of the test.

    ``adsets`` has test_id, adset_id and the excluded market list; ad sets in ``managed`` are left alone.
    """
    open_sets = adsets if managed is None else adsets.join(managed.select("test_id", "adset_id"), ["test_id", "adset_id"], "left_anti")
    wanted = open_sets.select("test_id", "adset_id").join(assignment.filter("cell = 'holdout'").select("test_id", "geo"), "test_id")
    existing = open_sets.select("test_id", "adset_id", F.explode("excluded").alias("geo"))
    return wanted.join(existing, ["test_id", "adset_id", "geo"], "left_anti")


def targeting_snapshots(adsets: DataFrame, plan: DataFrame) -> DataFrame:
    """Exclusion lists as they were before the plan touched them."""
    return adsets.join(plan.select("test_id", "adset_id").distinct(), ["test_id", "adset_id"], "left_semi")


def revert_plan(snapshots: DataFrame) -> DataFrame:
    """The first snapshot of every ad set is what a revert restores."""
    return first_per_key(snapshots, ["test_id", "adset_id"], ["taken_at"])


def with_report_flag(designs: DataFrame, reports: DataFrame) -> DataFrame:
    ids = reports.select("test_id", F.lit(True).alias("_has")).distinct()
    return designs.join(ids, "test_id", "left").withColumn("has_report", F.coalesce("_has", F.lit(False))).drop("_has")


# ---- alert table ----------------------------------------------------------------------------


def alert(rows: DataFrame, rule: str, severity: str, subject: Column, at: Column | None, value: Column, threshold: Column) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"),
        (F.lit(None) if at is None else at).cast("date").alias("at"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"))


def alert_table(
    mroi: DataFrame, revenue: DataFrame, betas: DataFrame, errors: DataFrame, gaps: DataFrame, rhats: DataFrame,
    failures: DataFrame | None = None, new_events: DataFrame | None = None,
) -> DataFrame:
    """All rules' findings as rows; inputs are the rule tables above, which carry the threshold that was applied."""
    hit = lambda df: df.filter("is_alert")
    parts = [
        alert(hit(mroi), "mroi_drop", "high", F.col("channel"), F.col("week"), F.col("drop_pct"), F.col("threshold")),
        alert(hit(revenue), "revenue_drop", "high", F.lit("marketplace"), F.col("week"), F.col("drop_pct"), F.col("threshold")),
        alert(hit(betas), "beta_decay", "medium", F.col("channel"), F.col("date"), F.col("drop_pct"), F.col("threshold")),
        alert(errors.filter("needs_refit"), "high_error", "high", F.lit("model"), F.col("date"), F.col("mape") * 100, F.col("threshold")),
        alert(gaps.filter("is_large"), "attribution_gap", "high", F.col("channel"), None, F.abs("delta") * 100, F.col("threshold")),
        alert(rhats.filter("is_high"), "no_convergence", "critical", F.col("parameter"), None, F.col("rhat"), F.col("threshold")),
    ]
    if failures is not None:
        parts.append(alert(failures, "failed_load", "critical", F.col("task"), F.col("at"), F.lit(None), F.lit(0.0)))
    if new_events is not None:
        parts.append(alert(new_events, "new_calibration", "info", F.col("channel"), F.col("test_end_date"), F.col("implied_roi"), F.lit(0.0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
