"""Augmented synthetic control: simplex weights, ridge bias correction, placebos.

Everything is solved from two small squares of each test. Donor weights need only the donors' products summed over the pre
dates; the ridge, its leave-one-out errors and its forecasts need only the dates' products summed over the donors. Both are
shared by all targets of a test: a placebo's own series is taken out of the second one as a rank-one step, and the dates a
target lacks are taken out of the first one. No solver sees a market-date panel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.stats import normal_cdf
from liftfield.operators.causal import conformal_inference
from liftfield.operators.panel import TREATED_UNIT, on_calendar
from liftfield.session import cut_lineage, spread

RIDGE_GRID = np.logspace(-2, 4, 20)
MIN_PRE, MIN_POST, MIN_DONORS = 7, 3, 3
#: Targets solved by one row of a solver's input.
TARGETS = 16


def unit_series(panel: DataFrame, value: str = "revenue", keys: list[str] = ["test_id"]) -> DataFrame:
    """Observed series only: the treatment mean per date and one series per common donor."""
    treated = panel.filter("cell = 'treatment'").groupBy(*keys, "period", "date").agg(F.avg(value).alias("y"))
    donors = panel.filter("cell = 'holdout'").groupBy(*keys, "geo", "period", "date").agg(F.avg(value).alias("y"))
    both = donors.groupBy(*keys, "geo").agg(F.count_distinct("period").alias("n")).filter("n = 2").select(*keys, "geo")
    kept = donors.join(both, [*keys, "geo"])
    return treated.select(*keys, "period", "date", F.lit(TREATED_UNIT).alias("unit"), "y").unionByName(
        kept.select(*keys, "period", "date", F.col("geo").alias("unit"), "y"))


# ---- small numeric helpers ------------------------------------------------------------------


def simplex_from_gram(gram: np.ndarray, level: float, tol: float = 1e-12) -> np.ndarray:
    """min w'Gw with w ≥ 0 and Σw = 1, by adding the most useful donor and re-solving the small active set.

    G holds the products of the donors' gaps to the target, so each active set has the closed form w ∝ G⁻¹1. Ends when the
    duality gap, which bounds the excess loss, is below ``tol`` of the loss; the loss falls with every entering donor, so no
    active set comes back. A donor that is active already can only enter again by rounding, at the accuracy of the numbers.
    ``level`` is the target's sum of squares.
    """
    gram = gram.copy()
    n, floor = len(gram), 1e-15 * max(level, 1e-12)
    gram[np.diag_indices(n)] += 1e-12 * np.trace(gram) / n + 1e-300
    active = [int(np.argmin(np.diag(gram)))]
    w = np.zeros(n)
    w[active] = 1.0
    while True:
        slope = gram @ w
        entering = int(np.argmin(slope))
        if 2.0 * (slope @ w - slope[entering]) <= max(tol * (slope @ w), floor) or entering in active:
            break
        active.append(entering)
        while True:
            solved = np.linalg.lstsq(gram[np.ix_(active, active)], np.ones(len(active)), rcond=None)[0]
            goal, now = solved / solved.sum(), w[active]
            if goal.min() > 0.0:
                w[active] = goal
                break
            down = goal <= 0.0
            share = (now[down] / np.maximum(now[down] - goal[down], 1e-300)).min()
            w[active] = np.where(now + share * (goal - now) > 1e-14, now + share * (goal - now), 0.0)
            kept = [j for j in active if w[j] > 0.0]
            if len(kept) == len(active):
                break
            active = kept
    return w / w.sum()


def simplex_weights(y: np.ndarray, x: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """min ‖y − xw‖² with w ≥ 0 and Σw = 1."""
    gaps = x - y[:, None]
    return simplex_from_gram(gaps.T @ gaps, float(y @ y), tol)


def centred(kernel: np.ndarray, pre: np.ndarray) -> np.ndarray:
    """Products of dates × pre dates after every donor's pre mean is taken off."""
    k = kernel[:, pre]
    return k - k.mean(axis=1)[:, None] - kernel[np.ix_(pre, pre)].mean(axis=0)[None, :] + kernel[np.ix_(pre, pre)].mean()


class Ridge:
    """Ridge regression on the donors through the dates' centred products (intercept not penalised)."""

    def __init__(self, kernel: np.ndarray, pre: np.ndarray):
        self.cross = centred(kernel, pre)
        vals, self.vecs = np.linalg.eigh(self.cross[pre])
        # directions that no donor moves in are zero but for rounding, which a small penalty would blow up
        self.vals = np.where(vals > 1e-11 * max(vals.max(initial=0.0), 1e-300), vals, 0.0)

    def best_alpha(self, y: np.ndarray) -> float:
        """Penalty with the smallest exact leave-one-out error."""
        rotated = self.vecs.T @ (y - y.mean())
        errors = []
        for a in RIDGE_GRID:
            shrink = self.vals / (self.vals + a)
            residual = (y - y.mean()) - self.vecs @ (shrink * rotated)
            leverage = (self.vecs**2 * shrink).sum(axis=1) + 1.0 / len(y)
            errors.append(np.mean((residual / np.maximum(1.0 - leverage, 1e-12)) ** 2))
        return float(RIDGE_GRID[int(np.argmin(errors))])

    def predict(self, y: np.ndarray, alpha: float) -> np.ndarray:
        """Fitted values of the pre dates' ``y`` on all dates."""
        dual = self.vecs @ np.where(self.vals > 0, (self.vecs.T @ (y - y.mean())) / (self.vals + alpha), 0.0)
        return y.mean() + self.cross @ dual


def ridge_alpha(y: np.ndarray, x: np.ndarray) -> float:
    return Ridge(x @ x.T, np.arange(len(y))).best_alpha(y)


def ridge_predict(y: np.ndarray, x: np.ndarray, x_new: np.ndarray, alpha: float) -> np.ndarray:
    rows = np.vstack([x, x_new])
    return Ridge(rows @ rows.T, np.arange(len(y))).predict(y, alpha)[len(y) :]


# ---- sums of products -----------------------------------------------------------------------


def filled_units(series: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, unit, period, date, y, z, seen): every unit on its test's calendar of dates with a donor.

    ``y`` is as observed, ``z`` filled forward, then back, then with 0, and measured from the test's mean donor value, which
    keeps the products free of cancellation; ``seen`` says that the unit can be a target on that date.
    """
    donors = series.where((F.col("unit") != TREATED_UNIT) & F.col("y").isNotNull())
    dates = donors.groupBy(*keys, "period", "date").agg(F.count("*").alias("n"))
    calendar = dates.groupBy(*keys, "period").agg(F.array_sort(F.collect_list(F.struct("date", "n"))).alias("days"))
    cells = on_calendar(series, calendar, [*keys, "period"], "unit")
    middle = donors.groupBy(*keys).agg(F.avg("y").alias("middle"))
    others = F.col("n") - F.when(F.col("unit") == TREATED_UNIT, 0).otherwise(1)
    return cells.join(middle, keys).select(
        *keys, "unit", "period", "date", "y", (F.col("z") - F.col("middle")).alias("z"), (F.col("y").isNotNull() & (others >= 1)).alias("seen"), "middle")


def packed_rows(df: DataFrame, keys: list[str], fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """``fn`` over rows that hold arrays, a few at a time."""
    kind = pa.schema([*((k, pa.string()) for k in keys), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                out = list(fn(batch.slice(at, 1).to_pylist()[0]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)

    return df.mapInArrow(run, ", ".join([*(f"{k} string" for k in keys), schema]))


def products(vectors: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, square): Σ v v' over a test's rows, each a vector ``v`` of the same length; rows of a test are read as they come
    and only the square is held.
    """
    kind = pa.schema([*((k, pa.string()) for k in keys), ("square", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            ids = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)] if ids else [0]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                v = batch["v"].slice(at, to - at)
                m = v.flatten().to_numpy(zero_copy_only=False).reshape(to - at, -1)
                if ids[at] != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | {"square": total.ravel()}], kind)
                    key, total = ids[at], 0.0
                total = total + m.T @ m
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(keys, key, strict=True)) | {"square": total.ravel()}], kind)

    dealt = spread(vectors, *keys).sortWithinPartitions(*keys, by).select(*keys, "v")
    return dealt.mapInArrow(run, ", ".join([*(f"{k} string" for k in keys), "square array<double>"]))


def in_buckets(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets of a test dealt into as many buckets as their number asks for; a bucket is one row with its ``targets``."""
    count = targets.groupBy(*keys).agg(F.ceil(F.count("*") / TARGETS).alias("n_buckets"))
    bucket = F.pmod(F.xxhash64("unit"), F.col("n_buckets"))
    own = [c for c in targets.columns if c not in keys]
    return targets.join(count, keys).groupBy(*keys, bucket.alias("bucket")).agg(F.collect_list(F.struct(*own)).alias("targets"))


def donor_weights(cells: DataFrame, keys: list[str], placebos: bool) -> DataFrame:
    """(keys, target, donor, weight, loss, gap) of every target that has enough dates and donors.

    ``loss`` is the sum of squared pre gaps, ``gap`` the duality gap that bounds how far it is above the least one.
    """
    unit = F.struct("unit", "z", "seen")
    days = cells.groupBy(*keys, "period", "date").agg(F.array_sort(F.collect_list(unit)).alias("u"))
    pre = days.where("period = 'pre'")
    square = products(pre.select(*keys, "date", F.transform("u", lambda u: u.z).alias("v")), keys, "date")
    part = F.col("period") == "pre"
    own = cells.groupBy(*keys, "unit").agg(F.count_if(part & F.col("seen")).alias("n_pre"), F.count_if(~part & F.col("seen")).alias("n_post"))
    units = own.groupBy(*keys).agg(F.array_sort(F.collect_list("unit")).alias("units"))
    # dates that some unit lacks, to be taken out of that unit's sums
    short = pre.where(F.exists("u", lambda u: ~u.seen)).groupBy(*keys).agg(F.collect_list(F.struct(
        F.transform("u", lambda u: u.z).alias("z"), F.transform("u", lambda u: u.seen).alias("seen"))).alias("short"))
    wanted = own.where((F.col("n_pre") >= MIN_PRE) & (F.col("n_post") >= MIN_POST))
    wanted = wanted if placebos else wanted.where(F.col("unit") == TREATED_UNIT)
    rows = in_buckets(wanted.select(*keys, "unit"), keys).join(square, keys).join(units, keys).join(short, keys, "left")

    def solve(r: dict) -> Iterator[dict]:
        names, n = r["units"], len(r["units"])
        whole = np.array(r["square"]).reshape(n, n)
        z = np.array([d["z"] for d in r["short"] or []]).reshape(-1, n)
        seen = np.array([d["seen"] for d in r["short"] or []], bool).reshape(-1, n)
        for target in (t["unit"] for t in r["targets"]):
            me = names.index(target)
            away = z[~seen[:, me]]
            g = whole - away.T @ away
            donors = [j for j in range(n) if j != me and names[j] != TREATED_UNIT]
            if len(donors) < (1 if target == TREATED_UNIT else MIN_DONORS):
                continue
            gaps = g[np.ix_(donors, donors)] - g[donors, me][:, None] - g[me, donors][None, :] + g[me, me]
            w = simplex_from_gram(gaps, g[me, me])
            slope = gaps @ w
            loss = float(w @ slope)
            for j in range(len(w)):
                yield {k: r[k] for k in keys} | {"target": target, "donor": names[donors[j]], "weight": float(w[j]), "loss": loss, "gap": float(2 * (loss - slope.min()))}

    fields = [("target", pa.string()), ("donor", pa.string()), ("weight", pa.float64()), ("loss", pa.float64()), ("gap", pa.float64())]
    return packed_rows(spread(rows, *keys, "bucket"), keys, solve, "target string, donor string, weight double, loss double, gap double", fields)


def scm_weights(series: DataFrame, keys: list[str] = ["test_id"], placebos: bool = False) -> DataFrame:
    """(test, target, donor, weight, loss, gap) of the synthetic control of each target."""
    return donor_weights(cut_lineage(filled_units(series, keys)), keys, placebos)


def ascm_series(series: DataFrame, keys: list[str] = ["test_id"], placebos: bool = True) -> DataFrame:
    """Fitted series per target with the cross-validated and the fixed (1.0) penalty; written once, read many times.

    A date counts for a target if it has its own value and a donor other than itself does; donors without a value on it are
    filled along the test's calendar.
    """
    cells = cut_lineage(filled_units(series, keys))
    weights = cut_lineage(donor_weights(cells, keys, placebos).where("weight > 0"))
    place = F.struct((F.col("period") == "post").alias("p"), F.col("date").alias("d"))
    control = weights.join(cells.withColumnRenamed("unit", "donor"), [*keys, "donor"]).groupBy(*keys, F.col("target").alias("unit"), "period", "date").agg(
        F.sum(F.col("weight") * F.col("z")).alias("control"))
    lines = cells.join(control, [*keys, "unit", "period", "date"], "left")
    lines = lines.groupBy(*keys, "unit").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("at"), "z", "seen", "control", "middle"))).alias("line"), F.count("control").alias("n_control"))
    lines = cut_lineage(lines)
    kernel = products(lines.where(F.col("unit") != TREATED_UNIT).select(*keys, "unit", F.transform("line", lambda c: c.z).alias("v")), keys, "unit")
    rows = in_buckets(lines.where("n_control > 0").select(*keys, "unit", "line"), keys).join(kernel, keys)

    def solve(r: dict) -> Iterator[dict]:
        for t in r["targets"]:
            line, target = t["line"], t["unit"]
            z, control = (np.array([c[x] for c in line], float) for x in ("z", "control"))
            kernel = np.array(r["square"]).reshape(len(z), len(z))
            if target != TREATED_UNIT:
                kernel = kernel - np.outer(z, z)
            used = np.array([c["seen"] for c in line], bool)
            post = np.array([c["at"]["p"] for c in line], bool)[used]
            y, scm = z[used], control[used]
            pre = np.flatnonzero(~post)
            ridge = Ridge(kernel[np.ix_(used, used)], pre)
            alpha = ridge.best_alpha(y[pre])
            for mode, a in (("cv", alpha), ("fixed", 1.0)):
                synthetic = scm + ridge.predict((y - scm)[pre], a)
                for c, later, own, other in zip([c for c in line if c["seen"]], post, y, synthetic, strict=True):
                    yield {k: r[k] for k in keys} | {
                        "target": target, "penalty": mode, "alpha": a, "period": "post" if later else "pre", "date": c["at"]["d"],
                        "y": own + c["middle"], "synthetic": other + c["middle"], "gap": own - other}

    fields = [("target", pa.string()), ("penalty", pa.string()), ("alpha", pa.float64()), ("period", pa.string()), ("date", pa.date32()),
              ("y", pa.float64()), ("synthetic", pa.float64()), ("gap", pa.float64())]
    schema = "target string, penalty string, alpha double, period string, date date, y double, synthetic double, gap double"
    return cut_lineage(packed_rows(spread(rows, *keys, "bucket"), keys, solve, schema, fields))


# ---- results --------------------------------------------------------------------------------


def fit_metrics(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Effect, baseline, pre-period imbalance and R² per key from (period, y, synthetic, gap) rows."""
    pre, post = F.col("period") == "pre", F.col("period") == "post"
    agg = fitted.groupBy(*keys).agg(
        F.avg(F.when(post, F.col("gap"))).alias("absolute_lift"), F.avg(F.when(post, F.col("synthetic"))).alias("baseline"),
        F.stddev_samp(F.when(post, F.col("y"))).alias("outcome_sd"), F.avg(F.when(pre, F.col("gap") * F.col("gap"))).alias("mse"),
        F.avg(F.when(pre, F.abs("y"))).alias("level"), F.var_pop(F.when(pre, F.col("y"))).alias("spread"))
    return agg.select(
        *keys, "absolute_lift", "baseline", "outcome_sd", (F.sqrt("mse") / F.col("level")).alias("l2_imbalance"),
        F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).otherwise(0.0).alias("r_squared"))


def placebo_effects(fitted: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """Effect of each donor treated as if it were the target (fixed penalty)."""
    rows = fitted.filter((F.col("penalty") == "fixed") & (F.col("target") != TREATED_UNIT) & (F.col("period") == "post"))
    return rows.groupBy(*keys, "target").agg(F.avg("gap").alias("effect"))


def placebo_p(effects: DataFrame, placebos: DataFrame, keys: list[str] = ["test_id"]) -> DataFrame:
    """Share of other targets' placebo effects at least as large, never below 1/(n+1)."""
    others = placebos.select(*keys, F.col("target").alias("_t"), F.abs("effect").alias("_e"))
    # how many placebos reach a given size: one ordered pass over both lists, no pairing of targets
    marks = effects.select(*keys, "target", F.abs("absolute_lift").alias("_e"), F.lit(0).alias("is_placebo")).unionByName(
        others.select(*keys, F.col("_t").alias("target"), "_e", F.lit(1).alias("is_placebo")))
    w = W.Window.partitionBy(*keys).orderBy(F.col("_e").desc()).rangeBetween(W.Window.unboundedPreceding, 0)
    reached = marks.withColumn("_k", F.sum("is_placebo").over(w)).withColumn("_n", F.sum("is_placebo").over(W.Window.partitionBy(*keys)))
    own = others.withColumnRenamed("_t", "target").withColumnRenamed("_e", "_own")
    rows = reached.filter("is_placebo = 0").join(own, [*keys, "target"], "left")
    mine = F.col("_own").isNotNull()
    hits = F.col("_k") - F.when(mine & (F.col("_own") >= F.col("_e")), 1).otherwise(0)
    n = F.col("_n") - F.when(mine, 1).otherwise(0)
    return rows.select(*keys, "target", F.when(n > 0, F.greatest(hits / n, 1.0 / (n + 1.0))).alias("placebo_p"), n.alias("n_placebos"))


def ascm_results(fitted: DataFrame, keys: list[str] = ["test_id"], alpha: float = 0.05, n_perm: int = 2000, targets: str = "treatment") -> DataFrame:
    """Result row per target ("treatment", "donors" or "all" of them): conformal inference, p no smaller than the placebo p."""
    cv = fitted.filter("penalty = 'cv'")
    if targets != "all":
        cv = cv.filter(F.col("target") == TREATED_UNIT) if targets == "treatment" else cv.filter(F.col("target") != TREATED_UNIT)
    by = [*keys, "target"]
    metrics = fit_metrics(cv, by)
    conformal = conformal_inference(cv.select(*by, "period", "date", "gap"), by, alpha, n_perm)
    against = placebo_p(metrics, placebo_effects(fitted, keys), keys)
    rows = metrics.join(conformal, by).join(against, by, "left")
    p = F.greatest("p_value", F.coalesce("placebo_p", F.lit(0.0)))
    base, tau, se = F.col("baseline"), F.col("absolute_lift"), F.col("se")
    over = lambda x: F.when(base > 0, x / base).otherwise(0.0)
    return rows.select(
        *by, F.lit("ascm").alias("method"), "absolute_lift", over(tau).alias("relative_lift"), over(F.col("ci_lower")).alias("lift_lower_ci"),
        over(F.col("ci_upper")).alias("lift_upper_ci"), "se", p.alias("p_value"), (p < alpha).alias("is_significant"),
        F.when(F.col("outcome_sd") > 0, tau / F.col("outcome_sd")).otherwise(0.0).alias("cohen_d"),
        F.when(se > 0, normal_cdf(tau / se)).otherwise(0.5).alias("lift_likelihood"), "l2_imbalance", "r_squared", "baseline", "n_placebos")
