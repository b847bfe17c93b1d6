"""Structural time-series counterfactual: local linear trend plus the most correlated donors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.stats import normal_cdf, normal_quantile
from liftfield.operators.panel import TREATED_UNIT
from liftfield.operators.synth import fit_metrics, packed_rows
from liftfield.session import cut_lineage, spread

MIN_PRE = 14
LEVEL_RATIOS = (0.0, 1e-3, 1e-2, 0.1, 1.0)
TREND_RATIOS = (0.0, 1e-5, 1e-4, 1e-3, 1e-2)
DIFFUSE = 1e7


def donor_correlations(aligned: DataFrame) -> DataFrame:
    """|corr| of each donor with the treatment mean over the pre dates; 0 when a series is flat."""
    pre = aligned.filter("period = 'pre'")
    y = pre.filter(F.col("unit") == TREATED_UNIT).select("test_id", "date", F.col("y").alias("t"))
    x = pre.filter(F.col("unit") != TREATED_UNIT).select("test_id", "date", "unit", "y").join(y, ["test_id", "date"])
    agg = x.groupBy("test_id", "unit").agg(
        F.covar_pop("t", "y").alias("c"), F.stddev_pop("t").alias("st"), F.stddev_pop("y").alias("sx"))
    ok = (F.col("st") > 0) & (F.col("sx") > 0)
    return agg.select("test_id", "unit", F.when(ok, F.abs(F.col("c") / (F.col("st") * F.col("sx")))).otherwise(0.0).alias("abs_corr"))


def select_covariates(correlations: DataFrame, cap: int = 10, floor: float = 0.3, fallback: int = 3) -> DataFrame:
    """Donors above ``floor``, at most ``cap``; the top ``fallback`` when none is above it."""
    w = W.Window.partitionBy("test_id")
    order = w.orderBy(F.col("abs_corr").desc(), "unit")
    ranked = correlations.withColumn("rank", F.row_number().over(order)).withColumn(
        "n_good", F.count_if(F.col("abs_corr") > floor).over(w))
    keep = F.when(F.col("n_good") > 0, (F.col("abs_corr") > floor) & (F.col("rank") <= cap)).otherwise(F.col("rank") <= fallback)
    return ranked.filter(keep).select("test_id", "unit", "abs_corr", "rank")


def top_donors(correlations: DataFrame, n: int = 10) -> DataFrame:
    w = W.Window.partitionBy("test_id").orderBy(F.col("abs_corr").desc(), "unit")
    return correlations.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def filter_all(y: np.ndarray, x: np.ndarray, n_pre: int, q_level: np.ndarray, q_trend: np.ndarray):
    """Kalman filter of level, slope and constant coefficients, in units of the irregular variance, for all variance ratios
    at once: one pass over the dates with a state and a covariance for each ratio.

    Returns one-step means and variances (ratios × dates; post dates are forecast, never updated), the concentrated
    log-likelihoods and the irregular variances.
    """
    m, k = len(q_level), 2 + x.shape[1]
    state, cov = np.zeros((m, k)), np.tile(np.eye(k) * DIFFUSE, (m, 1, 1))
    means, variances = np.empty((m, len(y))), np.empty((m, len(y)))
    logs, squares, used = np.zeros(m), np.zeros(m), max(n_pre - k, 0)
    for i in range(len(y)):
        load = np.concatenate([[1.0, 0.0], x[i]])
        along = cov @ load
        mean, var = state @ load, along @ load + 1.0
        means[:, i], variances[:, i] = mean, var
        if i < n_pre:
            error = y[i] - mean
            if i >= k:
                logs, squares = logs + np.log(var), squares + error * error / var
            gain = along / var[:, None]
            state = state + gain * error[:, None]
            cov = cov - gain[:, :, None] * along[:, None, :]
        state[:, 0] += state[:, 1]
        cov[:, 0, :] += cov[:, 1, :]
        cov[:, :, 0] += cov[:, :, 1]
        cov[:, 0, 0] += q_level
        cov[:, 1, 1] += q_trend
    sigma2 = squares / max(used, 1)
    return means, variances, -0.5 * (used * np.log(np.maximum(sigma2, 1e-300)) + logs), sigma2


def forecast(y: np.ndarray, x: np.ndarray, n_pre: int) -> tuple[np.ndarray, np.ndarray]:
    """Counterfactual and its standard error on every date, at the likeliest variance ratios."""
    scale, centre, width = max(np.std(y[:n_pre]), 1e-9), x[:n_pre].mean(axis=0), np.maximum(x[:n_pre].std(axis=0), 1e-9)
    level, trend = (v.ravel() for v in np.meshgrid(LEVEL_RATIOS, TREND_RATIOS, indexing="ij"))
    means, variances, likelihood, sigma2 = filter_all((y - y[:n_pre].mean()) / scale, (x - centre) / width, n_pre, level, trend)
    best = int(np.argmax(likelihood))
    return means[best] * scale + y[:n_pre].mean(), np.sqrt(variances[best] * sigma2[best]) * scale


def structural_series(aligned: DataFrame) -> DataFrame:
    """One-step fit and forecast of every test; a row holds one series and at most ten covariates as arrays."""
    chosen = select_covariates(donor_correlations(aligned)).select("test_id", "unit")
    rows = aligned.join(chosen, ["test_id", "unit"], "left_semi").unionByName(aligned.filter(F.col("unit") == TREATED_UNIT))
    cell = F.struct((F.col("period") == "post").alias("post"), "date", "y")
    lines = rows.groupBy("test_id", "unit").agg(F.array_sort(F.collect_list(cell)).alias("line"))
    packed = lines.groupBy("test_id").agg(
        F.first(F.when(F.col("unit") == TREATED_UNIT, F.col("line")), ignorenulls=True).alias("line"),
        F.array_sort(F.collect_list(F.when(F.col("unit") != TREATED_UNIT, F.struct("unit", F.transform("line", lambda c: c["y"]).alias("x"))))).alias("donors"))

    def solve(r: dict) -> Iterator[dict]:
        line, n_x = r["line"] or [], len(r["donors"])
        n_pre = sum(not c["post"] for c in line)
        if n_pre < max(MIN_PRE, n_x + 4) or n_pre == len(line):
            return
        y = np.array([c["y"] for c in line], float)
        x = np.array([d["x"] for d in r["donors"]], float).reshape(n_x, len(y)).T
        synthetic, se = forecast(y, x, n_pre)
        for i, c in enumerate(line):
            yield {"test_id": r["test_id"], "period": "post" if c["post"] else "pre", "date": c["date"], "y": c["y"],
                   "synthetic": synthetic[i], "se": se[i], "is_burn_in": i < 2 + n_x}

    fields = [("period", pa.string()), ("date", pa.date32()), ("y", pa.float64()), ("synthetic", pa.float64()), ("se", pa.float64()), ("is_burn_in", pa.bool_())]
    schema = "period string, date date, y double, synthetic double, se double, is_burn_in boolean"
    return cut_lineage(packed_rows(spread(packed, "test_id"), ["test_id"], solve, schema, fields))


def structural_results(fitted: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Result row per test.

    The mean effect over independent daily forecast errors is Normal, so its spread, interval and tail are closed
    forms; p is the two-sided posterior tail.
    """
    rows = fitted.filter("NOT (period = 'pre' AND is_burn_in)").withColumn("gap", F.col("y") - F.col("synthetic"))
    metrics = fit_metrics(rows, ["test_id"])
    post = rows.filter("period = 'post'").groupBy("test_id").agg((F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("*")).alias("se"))
    z = normal_quantile(1 - alpha / 2)
    r = metrics.join(post, "test_id")
    tau, se, base = F.col("absolute_lift"), F.col("se"), F.col("baseline")
    over = lambda x: F.when(base > 0, x / base).otherwise(0.0)
    up = F.when(se > 0, normal_cdf(tau / se)).otherwise(0.5)
    p = 2 * F.least(up, 1 - up)
    return r.select(
        "test_id", F.lit("bsts").alias("method"), "absolute_lift", over(tau).alias("relative_lift"), over(tau - z * se).alias("lift_lower_ci"),
        over(tau + z * se).alias("lift_upper_ci"), "se", p.alias("p_value"), (p < alpha).alias("is_significant"),
        F.when(F.col("outcome_sd") > 0, tau / F.col("outcome_sd")).otherwise(0.0).alias("cohen_d"), up.alias("lift_likelihood"),
        "l2_imbalance", "r_squared")
