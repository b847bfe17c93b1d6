"""Media-mix inputs and effects: dense panels, adstock, saturation, channel effects, draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.hashing import hash32
from liftfield.functions.scalars import hill_share
from liftfield.operators.ranks import exact_quantiles
from liftfield.session import cut_lineage, small_side, spread, with_grand

# Discounts applied to attribution-based returns and their default.
PRIOR_DISCOUNTS = {
    "meta_performance": 0.65, "meta_awareness": 0.60, "google_brand_search": 0.85, "google_non_brand": 0.75, "tiktok": 0.65,
}

# Share of its contribution that stands for a channel's spend, its return's band and margin, revenue of an order.
SPEND_PROXY, BAND_LOW, BAND_HIGH, MARGINAL_SHARE, ORDER_VALUE = 0.3, 0.7, 1.3, 0.8, 75.0


# ---- dense panels ---------------------------------------------------------------------------


def spine(markets: DataFrame, dates: DataFrame, days: int = 1) -> DataFrame:
    """Every market on every listed date: each market unrolls the date range, then keeps the listed dates."""
    span = dates.agg(F.array(F.min("date"), F.max("date")).alias("ab")).withColumn("k", F.lit(1))
    ranged = markets.select("geo").withColumn("k", F.lit(1)).join(F.broadcast(span), "k")
    step = F.expr(f"interval {days} days")
    rows = ranged.filter(F.col("ab")[0].isNotNull()).select("geo", F.explode(F.sequence(F.col("ab")[0], F.col("ab")[1], step)).alias("date"))
    return rows.join(dates.select("date").distinct(), "date", "left_semi")


def _zero_if_absent(value: Column, has_geo: Column) -> Column:
    """A market that never appears is 0 everywhere; a gap inside one that does stays NULL."""
    return F.when(value.isNotNull(), value).when(has_geo.isNull(), F.lit(0.0))


def kpi_panel(outcomes: dict[str, DataFrame], markets: DataFrame) -> DataFrame:
    """One column per outcome on the dates all outcomes share, for every market."""
    tagged = None
    for name, df in outcomes.items():
        part = df.groupBy("geo", "date").agg(F.sum("revenue").alias("v")).select("geo", "date", F.lit(name).alias("o"), "v")
        tagged = part if tagged is None else tagged.unionByName(part)
    tagged = cut_lineage(tagged)
    dates = tagged.groupBy("date").agg(F.count_distinct("o").alias("n")).filter(F.col("n") == len(outcomes)).select("date")
    wide = tagged.groupBy("geo", "date").agg(*[F.max(F.when(F.col("o") == n, F.col("v"))).alias(n) for n in outcomes])
    seen = tagged.groupBy("geo").agg(*[F.max(F.when(F.col("o") == n, F.lit(1))).alias(f"_{n}") for n in outcomes])
    rows = spine(markets, dates).join(wide, ["geo", "date"], "left").join(seen, "geo", "left")
    return cut_lineage(rows.select("date", "geo", *[_zero_if_absent(F.col(n), F.col(f"_{n}")).alias(n) for n in outcomes]))


def media_panel(spend: DataFrame, markets: DataFrame, channels: list[str], discounts: dict[str, float]) -> DataFrame:
    """Long (date, geo, channel, spend, discounted_spend) on the dates of the first channel.

    Dates or markets a channel lacks are 0; a gap inside a present market on a present date stays NULL.
    """
    day = spend.filter(F.col("channel").isin(channels)).groupBy("date", "geo", "channel").agg(F.sum("spend").alias("v"))
    day = cut_lineage(day)
    reference = day.filter(F.col("channel") == channels[0]).select("date").distinct()
    names = F.array(*[F.lit(c) for c in channels])
    grid = spine(markets, reference).withColumn("channel", F.explode(names))
    has_geo = day.select("channel", "geo", F.lit(1).alias("_g")).distinct()
    has_date = day.select("channel", "date", F.lit(1).alias("_d")).distinct()
    rows = grid.join(day, ["date", "geo", "channel"], "left").join(has_geo, ["channel", "geo"], "left").join(
        has_date, ["channel", "date"], "left")
    value = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("_g").isNull() | F.col("_d").isNull(), F.lit(0.0))
    factor = F.lit(1.0)
    for c, d in discounts.items():
        factor = F.when(F.col("channel") == c, d).otherwise(factor)
    return rows.select("date", "geo", "channel", value.alias("spend"), (value * factor).alias("discounted_spend"))


def national_features(frames: dict[str, DataFrame]) -> DataFrame:
    """Outer merge by date of national feature tables, missing as 0; later tables get a suffix on a name clash.

    One tagged union and one aggregate instead of a chain of outer joins.
    """
    names: list[str] = []
    tagged = None
    for label, df in frames.items():
        for c in [c for c in df.columns if c != "date"]:
            name = c if c not in names else f"{c}_{label}"
            names.append(name)
            part = df.select("date", F.lit(name).alias("f"), F.col(c).cast("double").alias("v"))
            tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("date").agg(*[F.coalesce(F.max(F.when(F.col("f") == n, F.col("v"))), F.lit(0.0)).alias(n) for n in names])


def population_weights(population: DataFrame) -> DataFrame:
    """Share of the total population; a zero or missing total is an error."""
    rows = with_grand(population, t=F.sum("population"))
    share = F.when(F.col("t") > 0, F.col("population") / F.col("t"))
    return rows.select("geo", F.coalesce(share, F.raise_error(F.lit("population total is zero")).cast("double")).alias("weight"))


def input_bundle(store, marketplace, spend, features, population, markets, channels, discounts) -> dict[str, DataFrame]:
    """Every table the media-mix model needs."""
    kpi = kpi_panel({"store": store, "marketplace": marketplace}, markets)
    return {
        "kpi": kpi,
        "media": media_panel(spend, markets, channels, discounts),
        "features": kpi.select("date", "geo").join(national_features(features), "date", "left").fillna(0.0),
        "population": population_weights(population),
    }


# ---- transforms -----------------------------------------------------------------------------


def _lag_sum(x: Column, weights: list[float], w) -> Column:
    out = None
    for lag, weight in enumerate(weights):
        term = F.lit(weight) * F.coalesce(F.lag(x, lag).over(w), F.lit(0.0))
        out = term if out is None else out + term
    return out


def geometric_adstock(df: DataFrame, decay: float, max_lag: int, keys: list[str], column: str = "x") -> DataFrame:
    """Σ decay^l · x(t−l), l = 0…max_lag, in date order."""
    if not 0.0 < decay < 1.0 or max_lag < 1:
        raise ValueError("decay must lie in (0, 1) and max_lag be at least 1")
    w = W.Window.partitionBy(*keys).orderBy("date")
    return df.withColumn("adstock", _lag_sum(F.col(column), [decay**lag for lag in range(max_lag + 1)], w))


def weibull_weights(alpha: float, scale: float, shape: float, max_lag: int) -> list[float]:
    """Increments of the Weibull distribution function over 1…max_lag+1, times alpha."""
    cdf = [1.0 - math.exp(-((lag / scale) ** shape)) for lag in range(max_lag + 2)]
    return [alpha * (b - a) for a, b in zip(cdf, cdf[1:])]


def weibull_adstock(df: DataFrame, alpha: float, scale: float, shape: float, max_lag: int, keys: list[str], column: str = "x") -> DataFrame:
    """Weibull carry-over plus the immediate effect."""
    w = W.Window.partitionBy(*keys).orderBy("date")
    return df.withColumn("adstock", F.col(column) + _lag_sum(F.col(column), weibull_weights(alpha, scale, shape, max_lag), w))


def media_features(media: DataFrame, decay: float, max_lag: int, alpha: float, gamma: float) -> DataFrame:
    """Discounted spend → adstock → saturation per (geo, channel)."""
    x = media.withColumn("x", F.coalesce("discounted_spend", F.lit(0.0)))
    a = geometric_adstock(x, decay, max_lag, ["geo", "channel"])
    return a.select("date", "geo", "channel", "adstock", hill_share(F.col("adstock"), F.lit(alpha), F.lit(gamma)).alias("feature"))


# ---- effects --------------------------------------------------------------------------------


def effect_moments(features: DataFrame, kpi: DataFrame, outcomes: list[str], channels: list[str]) -> tuple[DataFrame, list[str]]:
    """Sums of products of each (outcome, geo) in one pass over the panel, and the columns they pair.

    The columns are 1, the channels, the market's mean outcome, the season's sine and cosine and the outcome; column
    ``m_i_j`` is the sum of column i times column j over the dates.
    """
    wide = features.groupBy("date", "geo").agg(
        *[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("feature"))), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(channels)])
    stacked = kpi.select("date", "geo", F.explode(F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.coalesce(F.col(o).cast("double"), F.lit(0.0)).alias("y")) for o in outcomes])).alias("o")).select("date", "geo", "o.*")
    level = stacked.groupBy("outcome", "geo").agg(F.avg("y").alias("level"))
    turn = 2 * math.pi * F.dayofyear("date") / 365.25
    names = ["one", *(f"x{i}" for i in range(len(channels))), "level", "season_sin", "season_cos", "y"]
    daily = [n for n in names if n != "level"]
    rows = stacked.join(wide, ["date", "geo"]).select("outcome", "geo", "y", F.lit(1.0).alias("one"), *[f"x{i}" for i in range(len(channels))], F.sin(turn).alias("season_sin"), F.cos(turn).alias("season_cos"))
    place = {n: i for i, n in enumerate(names)}
    sums = rows.groupBy("outcome", "geo").agg(*[
        F.sum(F.col(a) * F.col(b)).alias(f"m_{place[a]}_{place[b]}") for i, a in enumerate(daily) for b in daily[i:]]).join(level, ["outcome", "geo"])
    # the level is one number of the market, so its products are multiples of plain sums
    lev, one = place["level"], place["one"]
    cell = lambda a, b: F.col(f"m_{min(a, b)}_{max(a, b)}")
    extra = [(F.col("level") * cell(one, place[n])).alias(f"m_{min(lev, place[n])}_{max(lev, place[n])}") for n in daily]
    extra.append((F.col("level") * F.col("level") * cell(one, one)).alias(f"m_{lev}_{lev}"))
    return sums.select("*", *extra).drop("level"), names


def ridge_effects(moments: np.ndarray, n_channels: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Effects of the channels and which of them are kept, from one key's square of weighted sums.

    Features and outcome are brought to unit variance, the penalty is ``ridge`` over the outcome's deviation. Channels with
    a negative effect are dropped and the rest refitted until none is left.
    """
    mean = moments[0] / max(moments[0, 0], 1e-300)
    cov = moments / max(moments[0, 0], 1e-300) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    live = sd > 1e-12 * np.maximum(np.abs(mean), 1e-300)
    used = live[1:-1].copy()
    effect = np.zeros(len(used))
    scale = np.where(live, sd, 1.0)
    corr = cov / np.outer(scale, scale)
    while used.any() and live[-1]:
        at = np.flatnonzero(used)
        square = corr[np.ix_(at + 1, at + 1)] + ridge / sd[-1] * np.eye(len(at))
        lower = np.linalg.cholesky(square)
        solved = np.linalg.solve(lower.T, np.linalg.solve(lower, corr[at + 1, -1]))
        effect[:] = 0.0
        effect[at] = solved * sd[-1] / scale[at + 1]
        negative = (effect < 0) & (np.arange(len(used)) < n_channels)
        if not negative.any():
            break
        used &= ~negative
    kept = used[:n_channels] | ~live[1 : n_channels + 1]
    return np.where(used[:n_channels], effect[:n_channels], 0.0), kept


def channel_effect_draws(
    features: DataFrame, kpi: DataFrame, outcomes: list[str], channels: list[str], weights: DataFrame | None = None, ridge: float = 0.1, n_boot: int = 200
) -> DataFrame:
    """(outcome, replicate, channel, effect, is_kept): ridge effects of saturated media with market level and season as controls.

    Replicate 0 uses every market once; the others draw as many markets with replacement. The panel is read once for the
    products of each outcome and market; outcomes and replicates are keys of sums of those, each solved by itself.
    """
    sums, names = effect_moments(features, kpi, outcomes, channels)
    weighted = sums.join(weights, "geo") if weights is not None else sums.withColumn("weight", F.lit(1.0))
    weighted = cut_lineage(weighted)
    k = len(names)
    cells = [c for c in weighted.columns if c.startswith("m_")]
    geos = weighted.select("geo").distinct()
    every = geos.withColumn("replicate", F.lit(0)).withColumn("times", F.lit(1).cast("bigint"))
    order = W.Window.orderBy("geo")  # one row a market
    picks = geos.withColumn("pick", F.row_number().over(order) - 1)
    size = geos.agg(F.count("*").alias("n"))
    drawn = spread(size.select("n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("replicate")), "replicate") if n_boot else None
    plan = every
    if drawn is not None:
        slots = drawn.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
        counts = slots.groupBy("replicate", (hash32(F.col("replicate"), F.col("slot")) % F.col("n")).cast("int").alias("pick")).agg(F.count("*").alias("times"))
        plan = every.unionByName(counts.join(small_side(picks), "pick").select("geo", "replicate", "times"))
    share = F.col("weight") * F.col("times")
    keyed = plan.join(small_side(weighted), "geo").groupBy("outcome", "replicate").agg(*[F.sum(share * F.col(c)).alias(c) for c in cells])
    kind = pa.schema([("outcome", pa.string()), ("replicate", pa.int32()), ("channel", pa.string()), ("effect", pa.float64()), ("is_kept", pa.bool_())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            square = np.zeros((batch.num_rows, k, k))
            for c in cells:
                i, j = map(int, c.split("_")[1:])
                square[:, i, j] = square[:, j, i] = batch[c].to_numpy(zero_copy_only=False)
            rows = []
            for m, outcome, replicate in zip(square, batch["outcome"].to_pylist(), batch["replicate"].to_pylist(), strict=True):
                effect, kept = ridge_effects(m, len(channels), ridge)
                rows += [dict(zip(kind.names, (outcome, replicate, c, float(e), bool(s)), strict=True)) for c, e, s in zip(channels, effect, kept, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, kind)

    return keyed.mapInArrow(solve, "outcome string, replicate int, channel string, effect double, is_kept boolean")


def fit_channel_effects(
    features: DataFrame, kpi: DataFrame, outcome: str | list[str], channels: list[str], weights: DataFrame | None = None, ridge: float = 0.1
) -> DataFrame:
    """(outcome, channel, effect, is_kept) of one or several outcomes, all in one job."""
    outcomes = [outcome] if isinstance(outcome, str) else outcome
    return channel_effect_draws(features, kpi, outcomes, channels, weights, ridge, 0).drop("replicate")


def contributions(features: DataFrame, draws: DataFrame) -> DataFrame:
    """Mean, p10 and p90 contribution per (date, geo, channel, outcome).

    Features are never negative, so percentiles of effect × feature are percentiles of the effect × feature:
    draws are reduced to one row per channel and outcome before they meet the panel.
    """
    keys = ["channel", "outcome"]
    effect = draws.groupBy(*keys).agg(F.avg("effect").alias("m")).join(exact_quantiles(draws, keys, "effect", {"p10": 0.1, "p90": 0.9}), keys)
    rows = features.join(small_side(effect), "channel")
    return rows.select(
        "date", "geo", "channel", "outcome", *[(F.col(c) * F.col("feature")).alias(n) for c, n in (
            ("m", "contribution_mean"), ("p10", "contribution_p10"), ("p90", "contribution_p90"))])


# ---- posterior draws ------------------------------------------------------------------------


def rhat(draws: DataFrame, threshold: float = 1.05) -> DataFrame:
    """Potential scale reduction per parameter from (parameter, chain, value) draws."""
    chains = draws.groupBy("parameter", "chain").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    agg = chains.groupBy("parameter").agg(F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.count("*").alias("n_chains"))
    total = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")
    value = F.when(F.col("w") > 0, F.sqrt(total / F.col("w"))).otherwise(1.0)
    return agg.select("parameter", "n_chains", value.alias("rhat"), (value > threshold).alias("is_high"), F.lit(threshold).alias("threshold"))


def varying_betas(draws: DataFrame) -> DataFrame:
    """Mean, p10 and p90 of the draws of each date and channel."""
    keys = ["date", "channel"]
    return draws.groupBy(*keys).agg(F.avg("value").alias("beta_mean")).join(exact_quantiles(draws, keys, "value", {"beta_p10": 0.1, "beta_p90": 0.9}), keys)


def saturation_curves(params: DataFrame, n_points: int = 100) -> DataFrame:
    """Curve rows from 0 to 1.5 × the largest observed spend."""
    top = F.greatest(F.col("spend_max") * 1.5, F.lit(1.0))
    g = params.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    spend = top * F.col("point") / (n_points - 1)
    return g.withColumn("spend", spend).select(
        "channel", "outcome", "point", "spend",
        (F.col("scale") * hill_share(F.col("spend"), F.col("alpha"), F.col("gamma"))).alias("revenue"))


# ---- attribution-based priors ---------------------------------------------------------------


def attribution_shares(attribution: DataFrame) -> DataFrame:
    """Channel share of attributed revenue; all 0 when there is none."""
    by = attribution.groupBy("channel").agg(F.sum("attributed_revenue").alias("revenue"))
    rows = with_grand(by, grand=F.sum("revenue"))
    share = F.when(F.col("grand") > 0, F.col("revenue") / F.col("grand")).otherwise(0.0)
    return rows.select("channel", "revenue", "grand", share.alias("share"))


def prior_means(attribution: DataFrame, spend: DataFrame | None, total_revenue: float, discounts: dict[str, float] = PRIOR_DISCOUNTS) -> DataFrame:
    """Discounted return per channel: attributed revenue over spend (0 without spend).

    With no spend table at all, total revenue over all attributed revenue takes the place of the return.
    """
    rows = attribution_shares(attribution)
    if spend is not None:
        by = spend.groupBy("channel").agg(F.sum("spend").alias("spend"))
        rows = rows.join(by, "channel", "left")
        roi = F.when(F.coalesce("spend", F.lit(0.0)) > 0, F.col("revenue") / F.col("spend")).otherwise(0.0)
    else:
        roi = F.when(F.col("revenue") > 0, F.col("share") * total_revenue / F.col("revenue")).otherwise(0.0)
    factor = F.lit(1.0)
    for c, d in discounts.items():
        factor = F.when(F.col("channel") == c, d).otherwise(factor)
    return rows.select("channel", F.when(F.col("grand") > 0, roi * factor).otherwise(0.0).alias("prior_mean"))


# ---- results --------------------------------------------------------------------------------


def channel_results(contribution: DataFrame, rhats: DataFrame | None = None) -> DataFrame:
    """Mean contribution with band, share of the outcome's total, return proxies; the baseline is left out."""
    agg = contribution.groupBy("channel", "outcome").agg(
        F.avg("contribution_mean").alias("contribution_mean"), F.avg("contribution_p10").alias("contribution_p10"),
        F.avg("contribution_p90").alias("contribution_p90"), F.sum("contribution_mean").alias("_s"))
    total = F.sum("_s").over(W.Window.partitionBy("outcome"))
    rows = agg.withColumn("_t", F.when(total == 0, 1.0).otherwise(total)).filter("channel <> 'baseline'")
    roi = F.col("contribution_mean") / F.greatest(F.col("contribution_mean") * SPEND_PROXY, F.lit(1.0))
    rows = rows.withColumn("contribution_share", F.col("contribution_mean") / F.col("_t")).withColumn("roi_mean", roi)
    rows = rows.withColumn("roi_p10", F.col("roi_mean") * BAND_LOW).withColumn("roi_p90", F.col("roi_mean") * BAND_HIGH).withColumn(
        "marginal_roi", F.col("roi_mean") * MARGINAL_SHARE).drop("_s", "_t")
    if rhats is None:
        return cut_lineage(rows.withColumn("rhat", F.lit(1.0)))
    own = rhats.select(F.col("parameter").alias("_p1"), F.col("rhat").alias("_r1"))
    shared = rhats.select(F.col("parameter").alias("_p2"), F.col("rhat").alias("_r2"))
    key = F.concat(F.lit("beta_"), F.col("channel"))
    rows = rows.join(own, F.concat(key, F.lit("_"), F.col("outcome")) == F.col("_p1"), "left").join(shared, key == F.col("_p2"), "left")
    return cut_lineage(rows.withColumn("rhat", F.coalesce("_r1", "_r2", F.lit(1.0))).drop("_p1", "_r1", "_p2", "_r2"))


def channel_iroas(results: DataFrame, spend: DataFrame, measured: DataFrame, order_value: float = ORDER_VALUE) -> DataFrame:
    """Measured iROAS where a test has one, else the model's; incremental order ratio in [0, 2] and cost per order."""
    rows = results.join(spend.select("channel", "spend"), "channel", "left").join(
        measured.select("channel", F.col("iroas").alias("_m")), "channel", "left").fillna(0.0, ["spend"])
    iroas = F.coalesce("_m", "roi_mean")
    base = F.greatest(F.col("contribution_mean"), F.lit(1e-6))
    factor = F.when(F.col("spend") > 0, iroas * F.col("spend")).otherwise(base) / base
    orders = iroas * F.col("spend") / order_value
    return rows.select(
        "channel", "outcome", F.round(iroas, 4).alias("iroas"),
        F.when(F.col("_m").isNotNull(), "geo_holdout").otherwise("mmm").alias("iroas_source"),
        F.round(F.greatest(F.least(factor, F.lit(2.0)), F.lit(0.0)), 4).alias("incremental_order_ratio"),
        F.when(orders > 0, F.round(F.col("spend") / orders, 2)).otherwise(0.0).alias("cpia"))
