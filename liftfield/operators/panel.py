"""Daily market panels: joins to tests, fills, spines and set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.operators.assign import with_cell
from liftfield.operators.staging import split_periods
from liftfield.session import cut_lineage, small_side


def test_panel(daily: DataFrame, tests: DataFrame, assignment: DataFrame) -> DataFrame:
    """(test_id, geo, cell, date, period, measures…) for every assigned market and day with data.

    Written once: estimators read the panel many times and must never go back to the raw facts behind ``daily``.
    """
    return cut_lineage(with_cell(split_periods(daily, tests), assignment))


def union_tagged(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL by name; columns a frame lacks become NULL."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _present(panel: DataFrame) -> DataFrame:
    return panel.select("test_id", "geo", "cell", "period").distinct()


def common_donors(panel: DataFrame) -> DataFrame:
    """Holdout markets with data in both periods."""
    return (
        panel.filter("cell = 'holdout'")
        .groupBy("test_id", "geo")
        .agg(F.count_distinct("period").alias("n"))
        .filter("n = 2")
        .select("test_id", "geo")
    )


def common_dates(panel: DataFrame) -> DataFrame:
    """Dates with a treatment row and a row of some common donor, per period."""
    donors = common_donors(panel).withColumn("is_donor", F.lit(True))
    tagged = panel.join(donors, ["test_id", "geo"], "left")
    return (
        tagged.groupBy("test_id", "period", "date")
        .agg(
            F.bool_or(F.col("cell") == "treatment").alias("has_t"),
            F.bool_or(F.coalesce("is_donor", F.lit(False))).alias("has_d"),
        )
        .filter("has_t AND has_d")
        .select("test_id", "period", "date")
    )


def on_calendar(series: DataFrame, calendar: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Every unit on its calendar: (keys, unit, the calendar's columns, y, z).

    ``calendar`` has one row for each value of ``keys``, its ``days`` a sorted array of structs that start with ``date``. A
    unit's own rows are folded along it in one pass over two sorted lists, one array for each unit: ``y`` is the value of
    that date if there is one, ``z`` the last value up to it, else the unit's first value on the calendar, else 0. Values
    on other dates are not used.
    """
    own = series.where("y IS NOT NULL").groupBy(*keys, unit).agg(F.collect_list(F.struct("date", F.lit(0).alias("mark"), "y")).alias("own"))
    marks = F.transform("days", lambda d: F.struct(d["date"].alias("date"), F.lit(1).alias("mark"), F.lit(None).cast("double").alias("y")))
    merged = F.array_sort(F.concat("own", marks))
    number = F.lit(None).cast("double")
    start = F.struct(F.lit(None).cast("date").alias("at"), number.alias("y"), number.alias("z"), F.array().cast("array<struct<y: double, z: double>>").alias("out"))

    def step(acc, e):
        here = acc["at"] == e["date"]
        y = F.when(here, acc["y"])
        z = F.coalesce(y, acc["z"])
        return F.when(e["mark"] == 0, F.struct(e["date"].alias("at"), e["y"].alias("y"), acc["z"].alias("z"), acc["out"].alias("out"))).otherwise(
            F.struct(acc["at"].alias("at"), acc["y"].alias("y"), z.alias("z"), F.array_append(acc["out"], F.struct(y.alias("y"), z.alias("z"))).alias("out")))

    filled = F.aggregate(merged, start, step, lambda acc: acc["out"])
    rows = own.join(calendar, keys).select(*keys, unit, "days", filled.alias("cells"))
    first = F.try_element_at(F.filter("cells", lambda c: c["y"].isNotNull()), F.lit(1))["y"]
    cells = rows.select(*keys, unit, first.alias("first"), F.explode(F.arrays_zip("days", "cells")).alias("c"))
    return cells.select(*keys, unit, "c.days.*", "c.cells.y", F.coalesce("c.cells.z", "first", F.lit(0.0)).alias("z"))


def fill_donor_grid(panel: DataFrame, value: str = "revenue") -> DataFrame:
    """Donor series on the grid of common dates: last value forward, then first value back, then 0, per period."""
    keys = ["test_id", "period"]
    calendar = common_dates(panel).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date"))).alias("days"))
    cells = panel.filter("cell = 'holdout'").join(common_donors(panel), ["test_id", "geo"], "left_semi").groupBy(*keys, "geo", "date").agg(F.avg(value).alias("y"))
    return on_calendar(cells, calendar, keys, "geo").select("test_id", "period", "date", F.col("geo").alias("unit"), F.col("z").alias("y"))


TREATED_UNIT = "*treatment*"


def aligned_series(panel: DataFrame, value: str = "revenue") -> DataFrame:
    """Treatment mean per date and filled donor series, long: (test_id, period, date, unit, y). Written once."""
    treated = panel.filter("cell = 'treatment'").groupBy("test_id", "period", "date").agg(F.avg(value).alias("y"))
    mean = treated.join(common_dates(panel), ["test_id", "period", "date"]).select(
        "test_id", "period", "date", F.lit(TREATED_UNIT).alias("unit"), "y"
    )
    return cut_lineage(mean.unionByName(fill_donor_grid(panel, value)))


def coverage_gaps(panel: DataFrame, assignment: DataFrame) -> DataFrame:
    """Assigned markets without any row in a period: (test_id, geo, cell, period)."""
    wanted = assignment.select(
        "test_id", "geo", "cell", F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("period")
    )
    return wanted.join(_present(panel), ["test_id", "geo", "cell", "period"], "left_anti")


def split_points(panel: DataFrame, n_splits: int = 5, low: float = 0.3, high: float = 0.7, min_dates: int = 21) -> DataFrame:
    """Placebo split dates: ``n_splits`` evenly spaced positions of the pre dates, truncated.

    Dates are numbered by a ranked aggregate on distinct dates only, never on panel rows.
    """
    dates = panel.filter("period = 'pre'").select("test_id", "date").distinct()
    w = W.Window.partitionBy("test_id")
    numbered = dates.withColumn("idx", F.row_number().over(w.orderBy("date")) - 1).withColumn("n", F.count("*").over(w))
    lo, hi = F.floor(F.col("n") * low), F.floor(F.col("n") * high)
    wanted = [
        F.floor(lo + (hi - lo) * (i / (n_splits - 1)) + 1e-9).alias(f"p{i}") if n_splits > 1 else lo.alias("p0")
        for i in range(n_splits)
    ]
    hit = numbered.filter(F.col("n") >= min_dates).select("test_id", "date", "idx", F.array(*wanted).alias("points"))
    return (
        hit.select("test_id", "date", "idx", F.posexplode("points").alias("split", "point"))
        .filter("idx = point")
        .select("test_id", "split", F.col("date").alias("split_date"), F.col("idx").cast("bigint").alias("n_pre"))
    )


def median_split(panel: DataFrame, min_dates: int = 14) -> DataFrame:
    """First date of the second half of the pre dates, for tests with enough of them."""
    dates = panel.filter("period = 'pre'").select("test_id", "date").distinct()
    w = W.Window.partitionBy("test_id")
    numbered = dates.withColumn("idx", F.row_number().over(w.orderBy("date")) - 1).withColumn("n", F.count("*").over(w))
    return numbered.filter((F.col("n") >= min_dates) & (F.col("idx") == F.floor(F.col("n") / 2))).select(
        "test_id", F.lit(0).alias("split"), F.col("date").alias("split_date")
    )


def relabel_periods(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Pre rows once per split with the period redrawn at the split date."""
    pre = panel.filter("period = 'pre'").drop("period")
    rows = pre.join(small_side(splits.select("test_id", "split", "split_date")), "test_id")
    period = F.when(F.col("date") < F.col("split_date"), "pre").otherwise("post")
    return rows.withColumn("period", period).drop("split_date")
