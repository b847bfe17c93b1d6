"""Treatment/holdout assignment of markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.functions.hashing import hash32


def _cell(is_holdout: Column) -> Column:
    return F.when(is_holdout, "holdout").otherwise("treatment").alias("cell")


def hash_assignment(markets: DataFrame, n_holdout: int) -> DataFrame:
    """First ``n_holdout`` markets of each test in hash order are held out."""
    order = W.Window.partitionBy("test_id").orderBy(hash32(F.col("test_id"), F.col("geo")), "geo")
    ranked = markets.withColumn("_rk", F.row_number().over(order))
    return ranked.select(*markets.columns, _cell(F.col("_rk") <= n_holdout))


def stratified_assignment(markets: DataFrame, n_holdout: int, stratum: str = "region") -> DataFrame:
    """Per stratum max(1, round-half-even(n·f)) holdouts, at most n − 1, in hash order."""
    by_test = W.Window.partitionBy("test_id")
    by_stratum = W.Window.partitionBy("test_id", stratum)
    order = by_stratum.orderBy(hash32(F.col("test_id"), F.col("geo")), "geo")
    n = F.count("*").over(by_stratum)
    wanted = F.bround(n * (F.lit(float(n_holdout)) / F.count("*").over(by_test)), 0)
    take = F.least(F.greatest(F.lit(1.0), wanted), n - 1.0)
    ranked = markets.withColumn("_rk", F.row_number().over(order)).withColumn("_take", take)
    return ranked.select(*markets.columns, _cell(F.col("_rk") <= F.col("_take")))


def with_cell(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Keep rows of assigned markets and add their cell."""
    return df.join(assignment.select("test_id", "geo", "cell"), ["test_id", "geo"])


def cell_lists(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("test_id", "cell").agg(
        F.count("*").alias("n_geos"), F.array_join(F.sort_array(F.collect_list("geo")), ",").alias("geos")
    )
