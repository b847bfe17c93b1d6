"""Difference-in-differences, replication inference and the ensemble; every row is keyed, so tests run together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.hashing import hash32
from liftfield.functions.stats import normal_cdf, normal_quantile, student_t_two_sided_p, two_sided_p
from liftfield.session import cut_lineage, small_side, spread

REPLICATES = 2000

# Base weight of each estimator in the ensemble.
BASE_WEIGHTS = {"ascm": 2.0, "bsts": 1.5, "did": 0.5}


def geo_changes(panel: DataFrame, keys: list[str] = ["test_id"], value: str = "revenue") -> DataFrame:
    """Per market: mean of the rows present before and after, and their difference."""
    pre = F.avg(F.when(F.col("period") == "pre", F.col(value)))
    post = F.avg(F.when(F.col("period") == "post", F.col(value)))
    return panel.groupBy(*keys, "geo", "cell").agg(pre.alias("pre_mean"), post.alias("post_mean")).withColumn(
        "diff", F.col("post_mean") - F.col("pre_mean")
    )


def _by_cell(cell: str, col: str):
    return F.when(F.col("cell") == cell, F.col(col))


def did_effects(changes: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """τ, counterfactual baseline, pooled spread and market counts per key."""
    t, h = "treatment", "holdout"
    stats = changes.groupBy(*keys).agg(
        F.avg(_by_cell(t, "diff")).alias("dt"), F.avg(_by_cell(h, "diff")).alias("dh"),
        F.var_samp(_by_cell(t, "diff")).alias("vt"), F.var_samp(_by_cell(h, "diff")).alias("vh"),
        F.count(_by_cell(t, "diff")).alias("n_treatment"), F.count(_by_cell(h, "diff")).alias("n_holdout"),
        F.avg(_by_cell(t, "pre_mean")).alias("pre_t"), F.avg(_by_cell(h, "pre_mean")).alias("pre_h"),
        F.avg(_by_cell(h, "post_mean")).alias("post_h"),
    ).filter("n_treatment > 0 AND n_holdout > 0")
    projected = F.col("pre_t") + F.col("post_h") - F.col("pre_h")
    return stats.select(
        *keys,
        (F.col("dt") - F.col("dh")).alias("absolute_lift"),
        F.when(projected > 0, projected).otherwise(F.col("post_h")).alias("baseline"),
        F.sqrt((F.col("vt") + F.col("vh")) / 2).alias("pooled_sd"),
        "n_treatment", "n_holdout", "vt", "vh",
    )


def _draws(sizes: DataFrame, keys: list[str], n_boot: int) -> DataFrame:
    """Resampling plan: for each replicate and slot, the 0-based index to pick — a hash, so retries agree."""
    reps = spread(sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))), *keys, "rep")
    slots = reps.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    return slots


def bootstrap_effects(changes: DataFrame, keys: list[str] = ["test_id"], n_boot: int = REPLICATES) -> DataFrame:
    """τ of every replicate; each cell's markets are resampled with replacement to the cell's size.

    Works on market-level differences, never on panel rows. The plan is spread by replicate and the differences are
    broadcast while they are small, so a replicate is drawn and averaged in one task.
    """
    used = changes.filter("diff IS NOT NULL").select(*keys, "cell", "geo", "diff")
    order = W.Window.partitionBy(*keys, "cell").orderBy("geo")
    indexed = used.withColumn("pick", F.row_number().over(order) - 1).drop("geo")
    sizes = used.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    pick = (hash32(*[F.col(k) for k in keys], F.col("rep"), F.col("cell"), F.col("slot")) % F.col("n")).cast("int")
    plan = _draws(sizes, keys, n_boot).withColumn("pick", pick)
    sampled = plan.join(small_side(indexed), [*keys, "cell", "pick"])
    by_rep = sampled.groupBy(*keys, "rep").agg(
        F.avg(_by_cell("treatment", "diff")).alias("t"), F.avg(_by_cell("holdout", "diff")).alias("h"))
    return by_rep.select(*keys, "rep", (F.col("t") - F.col("h")).alias("tau"))


def bootstrap_se(changes: DataFrame, keys: list[str] = ["test_id"], n_boot: int = REPLICATES) -> DataFrame:
    return bootstrap_effects(changes, keys, n_boot).groupBy(*keys).agg(F.stddev_pop("tau").alias("se"))


def difference_in_differences(
    panel: DataFrame, keys: list[str] = ["test_id"], value: str = "revenue", alpha: float = 0.05, n_boot: int = REPLICATES
) -> DataFrame:
    """One result row per key: lift, interval, p-value, effect size and likelihood of a positive lift."""
    changes = cut_lineage(geo_changes(panel, keys, value))
    return finish_did(did_effects(changes, keys), bootstrap_se(changes, keys, n_boot), keys, alpha)


def finish_did(effects: DataFrame, se: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    z = normal_quantile(1 - alpha / 2)
    rows = effects.join(se, keys)
    tau, base, s = F.col("absolute_lift"), F.col("baseline"), F.col("se")
    over = lambda x: F.when(base > 0, x / base).otherwise(0.0)
    p = F.when(s > 0, two_sided_p(tau / s)).otherwise(1.0)
    return rows.select(
        *keys, F.lit("did").alias("method"), "absolute_lift", over(tau).alias("relative_lift"),
        over(tau - z * s).alias("lift_lower_ci"), over(tau + z * s).alias("lift_upper_ci"), "se",
        p.alias("p_value"), (p < alpha).alias("is_significant"),
        F.when(F.col("pooled_sd") > 0, tau / F.col("pooled_sd")).otherwise(0.0).alias("cohen_d"),
        F.when(s > 0, normal_cdf(tau / s)).otherwise(0.5).alias("lift_likelihood"),
        F.lit(0.0).alias("l2_imbalance"), F.lit(0.0).alias("r_squared"), "baseline", "n_treatment", "n_holdout",
    )


def pooled_t(changes: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """Two-sample pooled t statistic on market differences and its degrees of freedom (NULL below 2 per cell)."""
    e = did_effects(changes, keys)
    nt, nh = F.col("n_treatment"), F.col("n_holdout")
    dof = nt + nh - 2
    pooled = ((nt - 1) * F.col("vt") + (nh - 1) * F.col("vh")) / dof
    scale = F.sqrt(pooled * (1.0 / nt + 1.0 / nh))
    ok = (nt >= 2) & (nh >= 2) & (scale > 0)
    return e.select(*keys, F.when(ok, F.col("absolute_lift") / scale).alias("t_stat"), F.when(ok, dof).alias("dof"))


def quick_did_p(changes: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    t = pooled_t(changes, keys)
    p = student_t_two_sided_p(F.col("t_stat"), F.col("dof").cast("double"))
    return t.withColumn("p_value", F.coalesce(p, F.lit(1.0)))


def bootstrap_p(gaps: DataFrame, keys: list[str] = ["test_id"], n_boot: int = REPLICATES) -> DataFrame:
    """Share of resampled centred gap means at least as large as the observed mean; never below 1/(B+1)."""
    by_key = W.Window.partitionBy(*keys)
    order = by_key.orderBy("date")
    centred = gaps.select(
        *keys, (F.row_number().over(order) - 1).alias("pick"), (F.col("gap") - F.avg("gap").over(by_key)).alias("g"))
    observed = gaps.groupBy(*keys).agg(F.avg("gap").alias("observed"), F.count("*").alias("n"))
    pick = (hash32(*[F.col(k) for k in keys], F.col("rep"), F.col("slot")) % F.col("n")).cast("int")
    plan = _draws(observed.select(*keys, "n"), keys, n_boot).withColumn("pick", pick)
    means = plan.join(small_side(centred), [*keys, "pick"]).groupBy(*keys, "rep").agg(F.avg("g").alias("m"))
    hits = means.join(observed, keys).groupBy(*keys).agg(
        F.first("observed").alias("observed"), F.avg((F.abs("m") >= F.abs("observed")).cast("double")).alias("share"))
    return hits.select(*keys, "observed", F.greatest("share", F.lit(1.0 / (n_boot + 1))).alias("p_value"))


def permuted_means(gaps: DataFrame, keys: list[str], n_perm: int = REPLICATES) -> DataFrame:
    """Mean of T_post residuals drawn without replacement, per replicate.

    A key's residuals are one short array (one value per date of its window), so replicates need no shuffle:
    each sorts the array by a hash and averages the head.
    """
    packed = gaps.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("date", "gap"))).alias("xs"),
        F.count_if(F.col("period") == "post").cast("int").alias("n_post"),
        F.avg(F.when(F.col("period") == "post", F.col("gap"))).alias("observed"),
    ).filter("n_post > 0")
    reps = spread(packed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1)))), *keys, "rep")
    ranked = F.array_sort(F.transform("xs", lambda x: F.struct(
        hash32(*[F.col(k) for k in keys], F.col("rep"), x["date"]).alias("h"), x["date"].alias("date"), x["gap"].alias("gap"))))
    head = F.slice(ranked, 1, F.col("n_post"))
    total = F.aggregate(head, F.lit(0.0), lambda acc, x: acc + x["gap"])
    return reps.select(*keys, "rep", "observed", (total / F.col("n_post")).alias("stat"))


def conformal_inference(gaps: DataFrame, keys: list[str] = ["test_id"], alpha: float = 0.05, n_perm: int = REPLICATES) -> DataFrame:
    """Permutation p = (k+1)/(B+1), ddof-0 se and interval from centred percentiles."""
    stats = permuted_means(gaps, keys, n_perm)
    agg = stats.groupBy(*keys).agg(
        F.first("observed").alias("observed"), F.avg("stat").alias("m"), F.stddev_pop("stat").alias("se"),
        F.percentile("stat", alpha / 2).alias("q_low"), F.percentile("stat", 1 - alpha / 2).alias("q_high"),
        F.count_if(F.abs("stat") >= F.abs("observed")).alias("k"))
    a = F.col("observed") - (F.col("q_high") - F.col("m"))
    b = F.col("observed") - (F.col("q_low") - F.col("m"))
    return agg.select(
        *keys, F.col("observed").alias("effect"), ((F.col("k") + 1.0) / (n_perm + 1.0)).alias("p_value"), "se",
        F.least(a, b).alias("ci_lower"), F.greatest(a, b).alias("ci_upper"))


# ---- ensemble -------------------------------------------------------------------------------

RESULT_COLUMNS = (
    "method", "absolute_lift", "relative_lift", "lift_lower_ci", "lift_upper_ci", "se", "p_value", "is_significant",
    "cohen_d", "lift_likelihood", "l2_imbalance", "r_squared",
)


def stack_results(results: list[DataFrame], keys: list[str] = ["test_id"]) -> DataFrame:
    """Rows of all estimators that produced one; a method that failed for a test simply has no row there."""
    out = None
    for df in results:
        part = df.select(*keys, *RESULT_COLUMNS).filter("absolute_lift IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def failed_methods(tests: DataFrame, results: DataFrame, methods=tuple(BASE_WEIGHTS), keys: list[str] = ["test_id"]) -> DataFrame:
    """(key, method) pairs without a result; a test with all methods listed has no ensemble."""
    wanted = tests.select(*keys, F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    return wanted.join(results.select(*keys, "method"), [*keys, "method"], "left_anti")


def ensemble_weights(results: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """Base weight × fit score, normalised per key; equal weights if every score is 0."""
    base = F.lit(0.5)
    for m, w in BASE_WEIGHTS.items():
        base = F.when(F.col("method") == m, w).otherwise(base)
    fit = 0.5 * F.greatest(F.lit(0.0), 1 - F.col("l2_imbalance") * 10) + 0.5 * F.greatest(F.lit(0.0), F.col("r_squared")) + 0.1
    w = W.Window.partitionBy(*keys)
    scored = results.withColumn("_raw", base * fit)
    total = F.sum("_raw").over(w)
    return scored.withColumn("weight", F.when(total > 0, F.col("_raw") / total).otherwise(1.0 / F.count("*").over(w))).drop("_raw")


def weighted_ensemble(results: DataFrame, keys: list[str] = ["test_id"], alpha: float = 0.05) -> DataFrame:
    """Weighted lift, widest interval, largest p; significant only if every method is; fit of the heaviest method."""
    rows = ensemble_weights(results, keys)
    best = F.max_by(F.struct("l2_imbalance", "r_squared"), F.struct("weight", "absolute_lift"))
    weighted = lambda c: F.sum(F.col(c) * F.col("weight")).alias(c)
    return rows.groupBy(*keys).agg(
        F.lit("ensemble").alias("method"), weighted("absolute_lift"), weighted("relative_lift"),
        F.min("lift_lower_ci").alias("lift_lower_ci"), F.max("lift_upper_ci").alias("lift_upper_ci"),
        F.max("p_value").alias("p_value"), F.bool_and("is_significant").alias("is_significant"),
        weighted("cohen_d"), weighted("lift_likelihood"), best.alias("_best"), F.count("*").alias("n_methods"),
    ).select(
        *keys, "method", "absolute_lift", "relative_lift", "lift_lower_ci", "lift_upper_ci", "p_value", "is_significant",
        "cohen_d", "lift_likelihood", "_best.l2_imbalance", "_best.r_squared", "n_methods")
