"""Panel quality: gaps, outliers, spikes, zeros, coverage, winsorising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.operators.panel import coverage_gaps

ALERT_COLUMNS = ("test_id", "severity", "category", "message", "affected_geos", "details")


def panel_summary(panel: DataFrame, keys: list[str] = ["test_id"], value: str = "revenue") -> DataFrame:
    """Rows, distinct markets and dates, mean, median and sample sd."""
    return panel.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("geo").alias("n_geos"),
        F.count_distinct("date").alias("n_dates"),
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.stddev_samp(value).alias("sd"),
    )


def missing_days(panel: DataFrame, assignment: DataFrame, max_missing: float = 0.10) -> DataFrame:
    """Share of the test's dates each assigned market lacks."""
    n_dates = panel.groupBy("test_id").agg(F.count_distinct("date").alias("n_dates"))
    seen = panel.groupBy("test_id", "geo").agg(F.count("*").alias("n_obs"))
    rows = assignment.select("test_id", "geo", "cell").join(n_dates, "test_id").join(seen, ["test_id", "geo"], "left")
    share = 1.0 - F.coalesce("n_obs", F.lit(0)) / F.col("n_dates")
    return rows.select(
        "test_id", "geo", "cell", F.coalesce("n_obs", F.lit(0)).cast("bigint").alias("n_obs"),
        share.alias("missing_share"), (share > max_missing).alias("is_missing"),
    )


def zscore_outliers(panel: DataFrame, threshold: float = 3.5, value: str = "revenue") -> DataFrame:
    """Rows whose value is more than ``threshold`` sample sds from their market's mean (7 rows or more)."""
    w = W.Window.partitionBy("test_id", "geo")
    mean, sd, n = F.avg(value).over(w), F.stddev_samp(value).over(w), F.count(value).over(w)
    scored = panel.withColumn("_n", n).withColumn("_sd", sd).withColumn("_m", mean)
    z = F.when((F.col("_n") >= 7) & (F.col("_sd") >= 1e-8), (F.col(value) - F.col("_m")) / F.col("_sd"))
    return scored.withColumn("z", z).filter(F.abs("z") > threshold).drop("_n", "_sd", "_m")


def spike_counts(panel: DataFrame, threshold: float = 3.0, value: str = "revenue") -> DataFrame:
    """Per market: day-over-day moves larger than ``threshold`` × the median move (mean when that is ~0)."""
    w = W.Window.partitionBy("test_id", "geo").orderBy("date")
    moves = panel.select("test_id", "geo", F.abs(F.col(value) - F.lag(value).over(w)).alias("move"))
    by_geo = moves.groupBy("test_id", "geo").agg(
        F.count("*").alias("n"), F.median("move").alias("med"), F.avg("move").alias("mean")
    )
    base = F.when(F.col("med") >= 1e-8, F.col("med")).when(F.col("mean") >= 1e-8, F.col("mean"))
    usual = by_geo.filter("n >= 7").select("test_id", "geo", base.alias("base")).filter("base IS NOT NULL")
    return moves.join(usual, ["test_id", "geo"]).groupBy("test_id", "geo").agg(
        F.count_if(F.col("move") > threshold * F.col("base")).alias("n_spikes")
    )


def zero_days(panel: DataFrame, max_zero: float = 0.20, value: str = "revenue") -> DataFrame:
    share = F.avg((F.col(value) <= 0).cast("double"))
    return panel.groupBy("test_id", "geo").agg(share.alias("zero_share")).withColumn(
        "is_zero", F.col("zero_share") > max_zero
    )


def _alert(rows: DataFrame, severity, category: str, message: Column, geos: Column, details: dict[str, Column]) -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    detail = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(
        "test_id", severity.alias("severity"), F.lit(category).alias("category"), message.alias("message"),
        geos.alias("affected_geos"), detail.alias("details"),
    )


def no_geos() -> Column:
    return F.array().cast("array<string>")


def missing_alerts(missing: DataFrame) -> DataFrame:
    """A blocker when more than half of the markets have gaps, else one warning per test."""
    bad = F.col("is_missing")
    per_test = missing.groupBy("test_id").agg(
        F.count("*").alias("n"), F.count_if(bad).alias("n_bad"),
        F.count_if(bad & (F.col("cell") == "treatment")).alias("n_t"), F.count_if(bad & (F.col("cell") == "holdout")).alias("n_h"),
        F.sort_array(F.collect_list(F.when(bad, F.col("geo")))).alias("geos"),
    ).filter("n_bad > 0")
    severity = F.when(F.col("n_bad") > F.col("n") * 0.5, "blocker").otherwise("warning")
    text = F.format_string("%d of %d markets have many missing days", "n_bad", "n")
    return _alert(per_test, severity, "missing_data", text, F.col("geos"),
                  {"missing_treatment": F.col("n_t"), "missing_holdout": F.col("n_h")})


def outlier_alerts(outliers: DataFrame) -> DataFrame:
    per_test = outliers.groupBy("test_id").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("geo")).alias("geos"))
    text = F.format_string("%d outlier rows in %d markets", "n", F.size("geos"))
    return _alert(per_test, "warning", "outlier", text, F.col("geos"), {"total_outliers": F.col("n")})


def spike_alerts(spikes: DataFrame, assignment: DataFrame) -> DataFrame:
    """One warning when a test has more than two spikes per assigned market."""
    size = assignment.groupBy("test_id").agg(F.count("*").alias("n_geos"))
    per_test = spikes.groupBy("test_id").agg(
        F.sum("n_spikes").alias("n"), F.sort_array(F.collect_list(F.when(F.col("n_spikes") > 0, F.col("geo")))).alias("geos")
    ).join(size, "test_id").filter("n > 2 * n_geos")
    text = F.format_string("%d sudden moves in %d markets", "n", F.size("geos"))
    return _alert(per_test, "warning", "spike", text, F.col("geos"), {"total_spikes": F.col("n")})


def zero_alerts(zeros: DataFrame) -> DataFrame:
    per_test = zeros.filter("is_zero").groupBy("test_id").agg(F.sort_array(F.collect_list("geo")).alias("geos"))
    text = F.format_string("%d markets have many days without revenue", F.size("geos"))
    return _alert(per_test, "warning", "zero_revenue", text, F.col("geos"), {})


def coverage_alerts(panel: DataFrame, assignment: DataFrame) -> DataFrame:
    """Blocker below 3 holdout markets in the post period, warnings for gaps and for short periods."""
    tests = assignment.select("test_id").distinct()
    gaps = coverage_gaps(panel, assignment)
    per_test = gaps.groupBy("test_id").agg(
        F.count_distinct("geo").alias("n_gap"),
        F.sort_array(F.collect_set(F.when((F.col("cell") == "holdout") & (F.col("period") == "post"), F.col("geo")))).alias("lost"),
        *[F.count_if((F.col("cell") == c) & (F.col("period") == p)).alias(f"n_{c}_{p}")
          for c in ("treatment", "holdout") for p in ("pre", "post")],
    )
    post = panel.filter("cell = 'holdout' AND period = 'post'").groupBy("test_id").agg(F.count_distinct("geo").alias("n_post_h"))
    state = tests.join(per_test, "test_id", "left").join(post, "test_id", "left").fillna(0)
    thin = F.col("n_post_h") < 3
    text = F.when(thin, F.format_string("only %d holdout markets have post data", "n_post_h")).otherwise(
        F.format_string("%d markets lack data in a period", "n_gap"))
    main = _alert(
        state.filter(thin | (F.col("n_gap") > 0)), F.when(thin, "blocker").otherwise("warning"), "coverage", text,
        F.when(thin, F.coalesce("lost", no_geos())).otherwise(no_geos()),
        {f"missing_{c}_{p}": F.col(f"n_{c}_{p}") for c in ("treatment", "holdout") for p in ("pre", "post")})
    days = panel.groupBy("test_id").agg(
        *[F.count_distinct(F.when(F.col("period") == p, F.col("date"))).alias(p) for p in ("pre", "post")])
    short = tests.join(days, "test_id", "left").fillna(0, ["pre", "post"])
    out = main
    for period, least in (("pre", 14), ("post", 7)):
        out = out.unionByName(_alert(
            short.filter(F.col(period) < least), "warning", "coverage",
            F.format_string(f"{period} period has only %d days", period), no_geos(), {}))
    return out


def anomaly_report(panel: DataFrame, assignment: DataFrame) -> DataFrame:
    """All data-quality findings of all tests as rows; a test without rows gets one blocker only."""
    present = panel.select("test_id").distinct()
    known = assignment.join(present, "test_id", "left_semi")
    parts = [
        missing_alerts(missing_days(panel, known)),
        outlier_alerts(zscore_outliers(panel)),
        spike_alerts(spike_counts(panel), known),
        zero_alerts(zero_days(panel)),
        coverage_alerts(panel, known),
    ]
    empty = assignment.select("test_id").distinct().join(present, "test_id", "left_anti")
    out = _alert(empty, "blocker", "coverage", F.lit("no data for this test"), no_geos(), {})
    for p in parts:
        out = out.unionByName(p)
    return out


def winsor_cutoffs(values: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Exact linear-interpolated percentiles of a small per-market table."""
    return values.groupBy(*keys).agg(
        F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"), F.count("*").alias("n_geos")
    )


def winsorise(panel: DataFrame, keys: list[str] = ["test_id", "period"], value: str = "revenue", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip market means to percentiles and scale their rows alike (scale within 0.1…10; 5 markets or more)."""
    means = panel.groupBy(*keys, "geo").agg(F.avg(value).alias("m"))
    cuts = winsor_cutoffs(means, keys, "m", low, high)
    clipped = F.least(F.greatest("m", "low"), "high")
    scale = F.when((F.col("n_geos") >= 5) & (F.col("m") > 0), F.least(F.greatest(clipped / F.col("m"), F.lit(0.1)), F.lit(10.0)))
    scales = means.join(cuts, keys).select(*keys, "geo", F.coalesce(scale, F.lit(1.0)).alias("scale"))
    return panel.join(scales, [*keys, "geo"]).withColumn(value, F.col(value) * F.col("scale"))


def compare_winsorised(raw: DataFrame, winsorised: DataFrame, keys: list[str] = ["test_id"], threshold: float = 0.30) -> DataFrame:
    """Divergence of the two lifts, whether outliers drive it and whether significance flips."""
    a = raw.select(*keys, F.col("relative_lift").alias("raw_lift"), F.col("p_value").alias("raw_p"))
    b = winsorised.select(*keys, F.col("relative_lift").alias("winsorised_lift"), F.col("p_value").alias("winsorised_p"))
    mean = (F.abs("raw_lift") + F.abs("winsorised_lift")) / 2
    gap = F.when(mean > 0.001, F.abs(F.col("raw_lift") - F.col("winsorised_lift")) / mean).otherwise(0.0)
    driven = F.col("divergence") > threshold
    flips = (F.col("raw_p") < 0.05) != (F.col("winsorised_p") < 0.05)
    return a.join(b, keys).withColumn("divergence", gap).withColumn("is_outlier_driven", driven).withColumn(
        "significance_flips", flips
    ).withColumn(
        "advice",
        F.when(driven & flips, "investigate").when(driven, "moderate").otherwise("robust"),
    )
