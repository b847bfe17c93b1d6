"""Placebo statistics, estimator agreement and the trust score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.functions.scalars import clamp
from liftfield.operators.causal import difference_in_differences
from liftfield.operators.panel import relabel_periods, split_points


def placebo_in_time(panel: DataFrame, value: str = "revenue", alpha: float = 0.05, n_splits: int = 5, n_boot: int = 2000) -> DataFrame:
    """Difference-in-differences at made-up start dates inside the pre period, all splits of all tests in one job."""
    splits = split_points(panel, n_splits)
    relabelled = relabel_periods(panel, splits)
    did = difference_in_differences(relabelled, ["test_id", "split"], value, alpha, n_boot)
    return did.join(splits.select("test_id", "split", "split_date"), ["test_id", "split"]).select(
        "test_id", F.lit("in_time").alias("placebo_type"), "split", "split_date",
        F.col("relative_lift").alias("estimated_effect"), "p_value", F.col("is_significant").alias("is_false_positive"))


def placebo_summary(placebos: DataFrame, tests: DataFrame) -> DataFrame:
    """Count, false-positive rate and pass rate per test; 0 false positives when there were no placebos."""
    agg = placebos.groupBy("test_id").agg(
        F.count("*").alias("n_placebos"), F.avg(F.col("is_false_positive").cast("double")).alias("fpr"))
    out = tests.select("test_id").join(agg, "test_id", "left").fillna(0)
    return out.select(
        "test_id", "n_placebos", F.col("fpr").alias("false_positive_rate"), (1 - F.col("fpr")).alias("pass_rate"),
        F.when(F.col("fpr") > 0.15, "blocker").when(F.col("fpr") > 0.10, "warning").otherwise("ok").alias("fpr_level"))


def estimator_agreement(results: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """0.4 direction + 0.3 magnitude (1 − CV, ddof 0) + 0.3 significance; 1 for a single method."""
    x = F.col("relative_lift")
    agg = results.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(x > 1e-6).alias("up"), F.count_if(x < -1e-6).alias("down"),
        F.avg(x).alias("m"), F.stddev_pop(x).alias("s"),
        F.count_distinct("is_significant").alias("kinds"))
    direction = F.when(F.col("up") + F.col("down") > 0, F.greatest("up", "down") / F.col("n")).otherwise(1.0)
    magnitude = F.when(F.abs("m") > 0.001, F.greatest(F.lit(0.0), 1 - F.col("s") / F.abs("m"))).otherwise(
        F.when(F.col("s") < 0.01, 1.0).otherwise(0.5))
    significance = F.when(F.col("kinds") == 1, 1.0).otherwise(0.5)
    score = F.when(F.col("n") <= 1, 1.0).otherwise(0.4 * direction + 0.3 * magnitude + 0.3 * significance)
    return agg.select(*keys, score.alias("agreement"))


BLOCKER_RULES = ("aa_test", "false_positives", "disagreement", "pre_fit")


def blockers_of():
    """Names of the blocking rules a row breaks (needs aa_passed, fpr, agreement, l2)."""
    rules = [
        (~F.col("aa_passed"), "aa_test"),
        (F.col("fpr") > 0.15, "false_positives"),
        (F.col("agreement") < 0.5, "disagreement"),
        (F.col("l2") > 0.10, "pre_fit"),
    ]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))


def warnings_of():
    rules = [
        ((F.col("fpr") > 0.10) & (F.col("fpr") <= 0.15), "false_positives"),
        ((F.col("agreement") >= 0.5) & (F.col("agreement") < 0.7), "disagreement"),
        ((F.col("l2") > 0.05) & (F.col("l2") <= 0.10), "pre_fit"),
        (F.col("r2") < 0.90, "r_squared"),
    ]
    return F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))


def trust_score(facts: DataFrame) -> DataFrame:
    """0–100 from (aa_passed, fpr, agreement, l2, r2); trustworthy needs no blocker and 70 points."""
    rows = facts.withColumn("blockers", blockers_of()).withColumn("warnings", warnings_of())
    fpr = F.when(F.col("fpr") <= 0.06, 20.0).when(F.col("fpr") <= 0.10, 15.0).when(F.col("fpr") <= 0.15, 8.0).otherwise(0.0)
    l2 = F.greatest(F.lit(0.0), 1 - F.col("l2") / 0.10) * 10
    r2 = F.greatest(F.lit(0.0), (F.col("r2") - 0.80) / 0.10) * 10  # not capped before the final clamp
    clean = F.size("blockers") == 0
    score = F.when(F.col("aa_passed"), 25.0).otherwise(0.0) + fpr + 20.0 * F.col("agreement") + l2 + r2 + F.when(clean, 15.0).otherwise(0.0)
    scored = rows.withColumn("trust_score", clamp(score, 0, 100))
    ok = clean & (F.col("trust_score") >= 70)
    low = F.when(clean & ~ok, F.array(F.lit("trust_score"))).otherwise(F.array().cast("array<string>"))
    return scored.withColumn("is_trustworthy", ok).withColumn("warnings", F.concat("warnings", low))
