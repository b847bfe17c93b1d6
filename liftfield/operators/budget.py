"""Budget allocation by ranked spend increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.scalars import central_marginal, hill_share, marginal_step
from liftfield.session import with_grand

OUTCOME_WEIGHTS = {"shopify": 0.7, "amazon": 0.3}


def channel_curves(curves: DataFrame) -> DataFrame:
    """(channel, outcome, scale, alpha, gamma) → one row per channel; a missing outcome has scale 0."""
    aggs = []
    for o in OUTCOME_WEIGHTS:
        for p, default in (("scale", 0.0), ("alpha", 1.0), ("gamma", 1.0)):
            aggs.append(F.coalesce(F.max(F.when(F.col("outcome") == o, F.col(p))), F.lit(default)).alias(f"{o}_{p}"))
    return curves.groupBy("channel").agg(*aggs)


def outcome_revenue(outcome: str, spend: Column, scale: Column | None = None) -> Column:
    s = F.col(f"{outcome}_scale") if scale is None else scale
    return s * hill_share(spend, F.col(f"{outcome}_alpha"), F.col(f"{outcome}_gamma"))


def blended_revenue(spend: Column, weights: dict[str, float] = OUTCOME_WEIGHTS) -> Column:
    out = None
    for o, w in weights.items():
        term = w * outcome_revenue(o, spend) * F.col("scale_factor")
        out = term if out is None else out + term
    return out


def _by_channel(values: dict[str, float], default: float = 0.0) -> Column:
    out = F.lit(float(default))
    for c, v in values.items():
        out = F.when(F.col("channel") == c, float(v)).otherwise(out)
    return out


def _check(budget: float, weights: dict[str, float], floors: dict[str, float]) -> None:
    if budget <= 0:
        raise ValueError("the budget must be positive")
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("outcome weights must sum to 1")
    if sum(floors.values()) > budget:
        raise ValueError("floors exceed the budget")


def allocate(
    curves: DataFrame, budgets: dict[str, float], floors: dict[str, float] | None = None, cap: float = 0.55,
    weights: dict[str, float] = OUTCOME_WEIGHTS, n_steps: int = 1000, scale_factors: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """Spend per (scenario, channel) that maximises blended revenue under a budget, floors and a share cap.

    Each channel's room is cut into equal increments. Their gains are made non-increasing (chord up to the point of
    highest average gain, running minimum after it), so taking the best increments first is optimal for curves that
    are concave past that point. All scenarios are ranked in one pass.
    """
    floors = floors or {}
    for b in budgets.values():
        _check(b, weights, floors)
    scenarios = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(float(b)).alias("budget")) for n, b in budgets.items()])
    rows = channel_curves(curves).withColumn("_s", F.explode(scenarios)).select("*", "_s.*").drop("_s")
    factor = F.lit(1.0)
    for scenario, per_channel in (scale_factors or {}).items():
        factor = F.when(F.col("scenario") == scenario, _by_channel(per_channel, 1.0)).otherwise(factor)
    total_floor = float(sum(floors.values()))
    rows = rows.withColumn("scale_factor", factor).withColumn("floor", _by_channel(floors)).withColumn(
        "step", (F.col("budget") - total_floor) / n_steps)
    room = F.least(F.lit(n_steps), F.floor((F.col("budget") * cap - F.col("floor")) / F.col("step") + 1e-9)).cast("int")
    rows = rows.withColumn("n", room)
    pieces = rows.filter("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda j: blended_revenue(F.col("floor") + j * F.col("step"), weights)
    pieces = pieces.select(
        "scenario", "channel", "j", (at(F.col("j") + 1) - at(F.col("j"))).alias("gain"),
        ((at(F.col("j") + 1) - at(F.lit(0))) / (F.col("j") + 1)).alias("mean_gain"))
    key = ["scenario", "channel"]
    knee = pieces.groupBy(*key).agg(
        F.max_by(F.struct("j", "mean_gain"), F.struct(F.col("mean_gain"), -F.col("j"))).alias("k")).select(
        *key, F.col("k.j").alias("knee"), F.col("k.mean_gain").alias("chord"))
    shaped = pieces.join(knee, key).withColumn("g", F.when(F.col("j") <= F.col("knee"), F.col("chord")).otherwise(F.col("gain")))
    falling = F.min("g").over(W.Window.partitionBy(*key).orderBy("j").rowsBetween(W.Window.unboundedPreceding, 0))
    ranked = shaped.withColumn("priority", falling).withColumn(
        "rank", F.row_number().over(W.Window.partitionBy("scenario").orderBy(F.col("priority").desc(), "channel", "j")))
    taken = ranked.filter(F.col("rank") <= n_steps).groupBy(*key).agg(F.count("*").alias("n_taken"))
    out = rows.join(taken, key, "left").fillna(0, ["n_taken"])
    spend = F.col("floor") + F.col("n_taken") * F.col("step")
    return out.withColumn("spend", spend).drop("n", "step")


def allocation_summary(allocation: DataFrame, weights: dict[str, float] = OUTCOME_WEIGHTS) -> DataFrame:
    """Expected revenue per outcome, blended revenue and blended return per scenario."""
    aggs = [F.sum(outcome_revenue(o, F.col("spend")) * F.col("scale_factor")).alias(f"{o}_revenue") for o in weights]
    by = allocation.groupBy("scenario", "budget").agg(F.sum("spend").alias("total_spend"), *aggs)
    blended = sum((w * F.col(f"{o}_revenue") for o, w in weights.items()), F.lit(0.0))
    return by.withColumn("blended_revenue", blended).withColumn(
        "blended_roas", F.when(F.col("total_spend") > 0, F.col("blended_revenue") / F.col("total_spend")).otherwise(0.0))


def allocation_bounds(curves: DataFrame, budget: float, sigmas: dict[str, float] | None = None, **kw) -> DataFrame:
    """Optimal spend with a lower and upper value: ±15 %, or optima at curve scales × (1 ± σ)."""
    if not sigmas:
        base = allocate(curves, {"base": budget}, **kw)
        return base.select("channel", "spend", (F.col("spend") * 0.85).alias("spend_lower"),
                           F.least(F.col("spend") * 1.15, F.lit(float(budget))).alias("spend_upper"))
    factors = {"low": {c: max(1 - s, 1e-6) for c, s in sigmas.items()}, "high": {c: 1 + s for c, s in sigmas.items()}}
    rows = allocate(curves, {"base": budget, "low": budget, "high": budget}, scale_factors=factors, **kw)
    pick = lambda s: F.max(F.when(F.col("scenario") == s, F.col("spend")))
    return rows.groupBy("channel").agg(
        pick("base").alias("spend"), F.greatest(pick("low"), F.lit(0.0)).alias("spend_lower"),
        F.least(pick("high"), F.lit(float(budget))).alias("spend_upper"))


def marginal_returns(curves: DataFrame, spend: DataFrame, weights: dict[str, float] = OUTCOME_WEIGHTS) -> DataFrame:
    """Blended central-difference return of each channel at its current spend."""
    rows = channel_curves(curves).join(spend.select("channel", "spend"), "channel", "left").fillna(0.0, ["spend"])
    rows = rows.withColumn("scale_factor", F.lit(1.0))
    x = F.col("spend")
    return rows.select("channel", "spend", central_marginal(lambda s: blended_revenue(s, weights), x, marginal_step(x)).alias("marginal_roi"))


def calibrate_scales(curves: DataFrame, measured: DataFrame, spend: DataFrame) -> DataFrame:
    """Scale one curve per channel so that its marginal return at current spend equals the measured iROAS.

    Only the first outcome that can be calibrated changes; non-positive spend or iROAS, or a flat curve, changes nothing.
    """
    rows = curves.join(measured.select("channel", "iroas"), "channel", "left").join(spend.select("channel", "spend"), "channel", "left")
    x = F.col("spend")
    curve = lambda s: F.col("scale") * hill_share(s, F.col("alpha"), F.col("gamma"))
    rows = rows.withColumn("_m", F.when((x > 0) & (F.col("iroas") > 0), central_marginal(curve, x, marginal_step(x))))
    order = F.lit(len(OUTCOME_WEIGHTS))
    for i, o in enumerate(OUTCOME_WEIGHTS):
        order = F.when(F.col("outcome") == o, i).otherwise(order)
    rows = rows.withColumn("_o", F.when(F.col("_m") >= 1e-9, order))
    first = F.min("_o").over(W.Window.partitionBy("channel"))
    hit = F.coalesce(F.col("_o") == first, F.lit(False))
    return rows.withColumn("calibrated", hit).withColumn(
        "scale", F.when(F.col("calibrated"), F.greatest(F.col("scale") * F.col("iroas") / F.col("_m"), F.lit(1e-6))).otherwise(F.col("scale"))
    ).select(*curves.columns, "calibrated")


# ---- greedy allocator -----------------------------------------------------------------------


def roas_revenue(spend: Column) -> Column:
    """spend × saturating return with the row's alpha, kappa and gamma; 0 without spend."""
    p = F.pow(spend, F.col("gamma"))
    return F.when(spend > 0, F.col("alpha") * p / (F.pow(F.col("kappa"), F.col("gamma")) + p) * spend).otherwise(0.0)


def greedy_allocation(params: DataFrame, budgets: dict[str, float], floors: dict[str, float] | None = None, n_steps: int = 1000, delta: float = 500.0) -> DataFrame:
    """Step-by-step greedy by marginal return, as one ranking.

    Channels start at max(floor, 1 %). A step waits for the ones before it in its channel, so its priority is the
    running minimum of their marginal returns; the ``n_steps`` highest priorities are what the greedy loop picks.
    Starting points above the budget are scaled down to it.
    """
    floors = floors or {}
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(b)).alias("budget")) for n, b in budgets.items()])
    rows = params.withColumn("_s", F.explode(scenarios)).select("*", "_s.*").drop("_s")
    rows = rows.withColumn("start", F.greatest(_by_channel(floors), F.col("budget") * 0.01))
    used = rows.groupBy("scenario").agg(F.sum("start").alias("used"))
    rows = rows.join(used, "scenario").withColumn("step", (F.col("budget") - F.col("used")) / n_steps)
    pieces = rows.filter("step > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))
    x = F.col("start") + F.col("j") * F.col("step")
    gain = F.when(x > 0, (roas_revenue(x + delta) - roas_revenue(x)) / delta).otherwise(F.col("alpha"))
    key = ["scenario", "channel"]
    falling = F.min("gain").over(W.Window.partitionBy(*key).orderBy("j").rowsBetween(W.Window.unboundedPreceding, 0))
    ranked = pieces.withColumn("gain", gain).withColumn("priority", falling).withColumn(
        "rank", F.row_number().over(W.Window.partitionBy("scenario").orderBy(F.col("priority").desc(), "channel", "j")))
    taken = ranked.filter(F.col("rank") <= n_steps).groupBy(*key).agg(F.count("*").alias("n_taken"))
    out = rows.join(taken, key, "left").fillna(0, ["n_taken"])
    spend = F.when(F.col("step") > 0, F.col("start") + F.col("n_taken") * F.col("step")).otherwise(
        F.col("start") / F.col("used") * F.col("budget"))
    return out.withColumn("spend", spend).withColumn("revenue", roas_revenue(F.col("spend"))).drop("used", "step", "start", "n_taken")


def scenario_sweep(params: DataFrame, budget: float, floors: dict[str, float] | None = None, n_steps: int = 500) -> DataFrame:
    """Revenue and marginal return at budgets from −30 % to +30 % in 31 steps."""
    budgets = {f"{i:02d}": budget * (1 + (-0.30 + 0.02 * i)) for i in range(31)}
    rows = greedy_allocation(params, budgets, floors, n_steps)
    by = rows.groupBy("scenario", "budget").agg(F.sum("revenue").alias("revenue"))
    by = with_grand(by, base=F.max(F.when(F.col("scenario") == "15", F.col("revenue"))))
    moved = F.when(F.abs(F.col("budget") - budget) > 1, F.col("budget") - budget).otherwise(1000.0)
    return by.select("scenario", "budget", "revenue", ((F.col("revenue") - F.col("base")) / F.abs(moved)).alias("marginal_roas"))


def current_vs_optimal(results: DataFrame, optimal: DataFrame, budget: float, outcome: str = "shopify") -> DataFrame:
    """Contribution share × budget next to the optimal spend."""
    share = results.filter(F.col("outcome") == outcome).select("channel", "contribution_share")
    share = with_grand(share, total=F.sum("contribution_share"))
    total = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    current = share.select("channel", (F.col("contribution_share") / total * budget).alias("current_spend"))
    return current.join(optimal.select("channel", F.col("spend").alias("optimal_spend")), "channel", "left").withColumn(
        "change", F.col("optimal_spend") - F.col("current_spend"))


def take_increments(increments: DataFrame, budget: float) -> DataFrame:
    """Best increments first until the running spend would pass the budget, per scenario.

    ``increments`` has scenario, channel, j, step and gain; steps may differ between channels.
    """
    w = W.Window.partitionBy("scenario").orderBy(F.col("gain").desc(), "channel", "j").rowsBetween(W.Window.unboundedPreceding, 0)
    return increments.withColumn("spent", F.sum("step").over(w)).filter(F.col("spent") <= budget)
