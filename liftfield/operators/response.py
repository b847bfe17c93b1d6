"""Spend-response curves: market counterfactuals, Hill fits, optimum, bootstrap and curve tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from liftfield.functions.hashing import hash32
from liftfield.functions.scalars import hill_revenue, hill_slope
from liftfield.session import cut_lineage, small_side, spread

ALPHA_LOW = 0.1
GRID_POINTS = 10_000


def market_levels(panel: DataFrame, spend: DataFrame) -> DataFrame:
    """Per test and market: mean before, mean after, mean daily spend in the test period; missing = 0.

    ``spend`` is (test_id, geo, spend) rows of the test period.
    """
    levels = panel.groupBy("test_id", "geo", "cell").agg(
        F.avg(F.when(F.col("period") == "pre", F.col("revenue"))).alias("pre_avg"),
        F.avg(F.when(F.col("period") == "post", F.col("revenue"))).alias("post_avg"))
    daily = spend.groupBy("test_id", "geo").agg(F.avg("spend").alias("spend_avg"))
    return levels.join(daily, ["test_id", "geo"], "full").fillna(0.0, ["pre_avg", "post_avg", "spend_avg"])


def response_points(levels: DataFrame) -> DataFrame:
    """Treated markets with spend: x = mean spend, y = mean revenue above the organic counterfactual.

    Tests need 2 holdout and 3 treated markets, a holdout level above zero and 3 markets with spend.
    One row per market, written once because every later step reads it several times.
    """
    h, t = F.col("cell") == "holdout", F.col("cell") == "treatment"
    per_test = levels.groupBy("test_id").agg(
        F.count_if(h).alias("nh"), F.count_if(t).alias("nt"), F.count_if(t & (F.col("spend_avg") > 0)).alias("ns"),
        F.avg(F.when(h, F.col("pre_avg"))).alias("hp"), F.avg(F.when(h, F.col("post_avg"))).alias("hq"))
    usable = per_test.filter("nh >= 2 AND nt >= 3 AND ns >= 3 AND hp >= 1e-6").select(
        "test_id", (F.col("hq") / F.col("hp")).alias("organic_growth"))
    rows = levels.filter(t & (F.col("spend_avg") > 0)).join(usable, "test_id")
    return cut_lineage(rows.select(
        "test_id", "geo", F.col("spend_avg").alias("x"), (F.col("post_avg") - F.col("pre_avg") * F.col("organic_growth")).alias("y"),
        "organic_growth"))


# ---- curve fits: one row a key, its points as arrays --------------------------------------


def _curve(x: np.ndarray, k: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """``hill_revenue`` of scale 1 for every (k, alpha) and point."""
    power = np.maximum(x[None, :], 1e-10) ** alpha[:, None]
    return power / (np.maximum(k, 1e-10)[:, None] ** alpha[:, None] + power)


def _best_cell(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: np.ndarray, alpha: np.ndarray) -> tuple[float, float, float, float]:
    """Scale, k, alpha and error of the best cell; given k and alpha the curve is linear in its scale."""
    share = _curve(x, k, alpha)
    syh, shh = share @ (w * y), (share * share) @ w
    scale = np.maximum(np.divide(syh, shh, out=np.zeros_like(syh), where=shh > 0), 0.0)
    sse = np.sum(w * y * y) - 2 * scale * syh + scale * scale * shh
    at = np.lexsort((alpha, k, np.where(np.isnan(sse), np.inf, sse)))[0]
    return float(scale[at]), float(k[at]), float(alpha[at]), float(sse[at])


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, k0: float, alpha_high: float) -> tuple[float | None, float, float, bool]:
    alphas = np.arange(1, round(alpha_high * 10) + 1) / 10.0
    k, alpha = (g.ravel() for g in np.meshgrid(k0 * 10.0 ** (np.arange(-20, 21) / 10.0), alphas, indexing="ij"))
    _, k1, alpha1, _ = _best_cell(x, y, w, k, alpha)
    near = np.minimum(np.maximum(alpha1 + np.arange(-10, 11) / 100.0, ALPHA_LOW), alpha_high)
    k, alpha = (g.ravel() for g in np.meshgrid(k1 * 10.0 ** (np.arange(-20, 21) / 200.0), near, indexing="ij"))
    scale, k2, alpha2, sse = _best_cell(x, y, w, k, alpha)
    if not np.isnan(sse):
        return scale, k2, alpha2, True
    log = np.log1p(x)
    spread_ = np.var(log)
    slope = np.mean((log - log.mean()) * (y - y.mean())) / spread_ if spread_ > 0 else None
    return None if slope is None else float(slope * log.max() * 2), k0, 0.5, False


def fit_hill(points: DataFrame, keys: list[str], alpha_high: float = 3.0) -> DataFrame:
    """Hill curve per key on a grid over (k, alpha), then a finer grid around the best cell.

    ``points`` has x, y, a weight w and a starting half-saturation k0. Only the points are shuffled, packed into one row a
    key; grids live in the task that solves the row. Keys without a usable fit get the log-linear fallback and
    ``converged`` = false.
    """
    packed = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "w")]))).alias("p"), F.first("k0").cast("double").alias("k0"))
    kinds = {f.name: f.dataType for f in packed.schema.fields}
    out = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("r_max", T.DoubleType()), T.StructField("k", T.DoubleType()),
                        T.StructField("alpha", T.DoubleType()), T.StructField("converged", T.BooleanType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for points, k0 in zip(batch["p"].to_pylist(), batch["k0"].to_pylist(), strict=True):
                x, y, w = (np.array([q[c] for q in points], float) for c in ("x", "y", "w"))
                fits.append(_fit(x, y, w, k0, alpha_high))
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            found = [pa.array([f[i] for f in fits], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([*(batch[k] for k in keys), *found], [*keys, "r_max", "k", "alpha", "converged"])

    return cut_lineage(packed.mapInArrow(solve, out))


def anchored(points: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """Points plus (0, 0) per key, with the median positive spend as starting half-saturation."""
    k0 = points.groupBy(*keys).agg(F.median("x").alias("k0"))
    cols = points if weighted else points.withColumn("w", F.lit(1.0))
    rows = cols.select(*keys, "x", "y", "w").unionByName(
        k0.select(*keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w")))
    return rows.join(k0, keys)


def fit_response(points: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    return fit_hill(anchored(points, keys), keys)


def calibrate(curves: DataFrame, points: DataFrame, causal: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """Scale r so that predicted revenue over spend equals the causal iROAS (skipped when that is ≤ 0)."""
    pred = points.join(curves, keys).groupBy(*keys).agg(
        (F.sum(F.coalesce("w", F.lit(1.0)) * hill_revenue(F.col("x"), F.col("r_max"), F.col("k"), F.col("alpha")))
         / F.sum(F.coalesce("w", F.lit(1.0)) * F.col("x"))).alias("_p")
        if "w" in points.columns else
        (F.sum(hill_revenue(F.col("x"), F.col("r_max"), F.col("k"), F.col("alpha"))) / F.sum("x")).alias("_p"))
    rows = curves.join(pred, keys, "left").join(causal.select("test_id", F.col("iroas").alias("_i")), "test_id", "left")
    use = F.coalesce((F.col("_i") > 0) & (F.col("_p") > 1e-6), F.lit(False))
    return rows.withColumn("r_max", F.when(use, F.col("r_max") * F.col("_i") / F.col("_p")).otherwise(F.col("r_max"))).withColumn(
        "calibrated", use).drop("_p", "_i")


def optimal_spend(curves: DataFrame, keys: list[str], target: float = 1.0) -> DataFrame:
    """First of 10,000 spend levels up to max(3·current, 5·k) whose slope is below the target, else the last."""
    n = GRID_POINTS
    rows = curves.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("r_max", "k", "alpha", "current")])
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("optimal", T.DoubleType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(n)
        for batch in batches:
            best = []
            for r, k, alpha, current in zip(*(batch[c].to_pylist() for c in ("r_max", "k", "alpha", "current")), strict=True):
                tops = [v for v in (None if current is None else current * 3, None if k is None else k * 5) if v is not None]
                if not tops:
                    best.append(None)
                    continue
                s = 0.01 + (max(tops) - 0.01) * step / (n - 1)
                at = s
                if None not in (r, k, alpha):
                    low = np.maximum(s, 1e-10)
                    half, power = k**alpha, low**alpha
                    den = (half + power) ** 2
                    slope = np.where(den < 1e-20, 0.0, r * alpha * half * low ** (alpha - 1.0) / np.maximum(den, 1e-300))
                    at = s[slope < target]
                best.append(float(at[0]) if len(at) and at is not s else float(s[-1]))
            yield pa.record_batch([*(batch[k] for k in keys), pa.array(best, pa.float64())], [*keys, "optimal"])

    return rows.mapInArrow(solve, out)


def response_summary(curves: DataFrame, points: DataFrame, target: float = 1.0) -> DataFrame:
    """Fit quality, current and optimal state per market, change and direction."""
    by = points.groupBy("test_id").agg(
        F.avg("x").alias("current"), F.max("x").alias("x_max"), F.count("*").alias("n_geos"))
    rows = curves.join(by, "test_id")
    curve = lambda s: hill_revenue(s, F.col("r_max"), F.col("k"), F.col("alpha"))
    with_zero = points.select("test_id", "x", "y").unionByName(
        points.select("test_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).distinct()).join(curves, "test_id")
    fit = with_zero.groupBy("test_id").agg(
        F.sum(F.pow(F.col("y") - curve(F.col("x")), 2)).alias("ss_res"), (F.var_pop("y") * F.count("y")).alias("ss_tot"))
    rows = rows.join(fit, "test_id").join(optimal_spend(rows, ["test_id"], target), "test_id")
    change = F.when(F.col("current") > 0, (F.col("optimal") - F.col("current")) / F.col("current") * 100).otherwise(0.0)
    ratio = lambda s: F.when(s > 0, curve(s) / s).otherwise(0.0)
    return rows.select(
        "test_id", "r_max", "k", "alpha", "n_geos",
        F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(0.0).alias("r_squared"),
        (F.col("current") * F.col("n_geos")).alias("current_spend"), ratio(F.col("current")).alias("current_iroas"),
        hill_slope(F.col("current"), F.col("r_max"), F.col("k"), F.col("alpha")).alias("current_marginal"),
        (F.col("optimal") * F.col("n_geos")).alias("optimal_spend"), ratio(F.col("optimal")).alias("optimal_iroas"),
        change.alias("spend_change_pct"),
        F.when(change < -10, "decrease").when(change > 10, "increase").otherwise("maintain").alias("direction"),
        (F.col("optimal") > F.col("x_max") * 1.2).alias("is_extrapolated"))


def bootstrap_curves(points: DataFrame, causal: DataFrame | None = None, target: float = 1.0, n_boot: int = 200) -> DataFrame:
    """Curve and optimum of every replicate of every test: (test_id, rep, r_max, k, alpha, optimal).

    A replicate is a row with its markets' weights; it is fitted and searched where it lies.
    """
    order = W.Window.partitionBy("test_id").orderBy("geo")
    base = points.withColumn("pick", F.row_number().over(order) - 1).withColumn("k0", F.median("x").over(W.Window.partitionBy("test_id")))
    size = points.groupBy("test_id").agg(F.count("*").alias("n"))
    reps = spread(size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))), "test_id", "rep")
    slots = reps.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    weights = slots.withColumn("pick", (hash32(F.col("test_id"), F.col("rep"), F.col("slot")) % F.col("n")).cast("int")).groupBy(
        "test_id", "rep", "pick").agg(F.count("*").cast("double").alias("w"))
    sampled = weights.join(small_side(base.select("test_id", "pick", "x", "y", "k0")), ["test_id", "pick"])
    zero = sampled.groupBy("test_id", "rep").agg(F.first("k0").alias("k0")).select(
        "test_id", "rep", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), "k0")
    keys = ["test_id", "rep"]
    rows = cut_lineage(sampled.select(*keys, "x", "y", "w", "k0").unionByName(zero))
    curves = fit_hill(rows, keys)
    if causal is not None:
        curves = calibrate(curves, rows.filter("x > 0"), causal, keys)
    current = points.groupBy("test_id").agg(F.avg("x").alias("current"))
    curves = curves.join(current, "test_id")
    return cut_lineage(curves.join(optimal_spend(curves, keys, target), keys))


def optimum_interval(boot: DataFrame) -> DataFrame:
    """2.5/97.5 percentiles of the optimum; 0.5×/2× of current spend with fewer than 10 fits."""
    agg = boot.groupBy("test_id").agg(
        F.count("*").alias("n_fits"), F.percentile("optimal", 0.025).alias("low"), F.percentile("optimal", 0.975).alias("high"),
        F.first("current").alias("current"))
    few = F.col("n_fits") < 10
    return agg.select(
        "test_id", "n_fits", F.when(few, F.col("current") * 0.5).otherwise(F.col("low")).alias("optimal_lower"),
        F.when(few, F.col("current") * 2.0).otherwise(F.col("high")).alias("optimal_upper"))


def curve_table(curves: DataFrame, points: DataFrame, boot: DataFrame | None = None, target: float = 1.0, n_points: int = 100) -> DataFrame:
    """Chart points: spend, revenue, marginal and average return scaled to all markets, with bootstrap bands."""
    by = points.groupBy("test_id").agg(F.avg("x").alias("current"), F.max("x").alias("x_max"), F.count("*").alias("n_geos"))
    rows = curves.join(by, "test_id")
    rows = rows.join(optimal_spend(rows, ["test_id"], target), "test_id")
    top = F.greatest(F.col("current") * 2.5, F.col("optimal") * 1.5, F.col("x_max") * 1.5)
    grid = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1)))).withColumn(
        "s", F.lit(0.01) + (top - 0.01) * F.col("i") / (n_points - 1))
    revenue = hill_revenue(F.col("s"), F.col("r_max"), F.col("k"), F.col("alpha"))
    out = grid.select(
        "test_id", "i", "s", "n_geos", revenue.alias("rev"), hill_slope(F.col("s"), F.col("r_max"), F.col("k"), F.col("alpha")).alias("marginal"),
        (revenue / F.col("s")).alias("avg_return"))
    if boot is not None:
        b = boot.select("test_id", F.col("r_max").alias("br"), F.col("k").alias("bk"), F.col("alpha").alias("ba"))
        band = out.select("test_id", "i", "s").join(b, "test_id").groupBy("test_id", "i").agg(
            F.percentile(hill_revenue(F.col("s"), F.col("br"), F.col("bk"), F.col("ba")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
        out = out.join(band, ["test_id", "i"]).withColumn("low", F.col("q")[0]).withColumn("high", F.col("q")[1])
    else:
        out = out.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    n = F.col("n_geos")
    return out.select(
        "test_id", "i", (F.col("s") * n).alias("spend"), (F.col("rev") * n).alias("revenue"), (F.col("low") * n).alias("revenue_lower"),
        (F.col("high") * n).alias("revenue_upper"), "marginal", "avg_return")
