"""Ranks and quantiles over distinct values that no single task has to hold.

Distinct values with their multiplicities are dealt by range over (key, value), so a key with a third of all rows lies in
many parts. Each part counts its own rows, the parts' totals of a key give every part its start, and a value's place is
that start plus what precedes it in its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from liftfield.session import cut_lineage


def running_counts(df: DataFrame, keys: list[str], value: str, descending: bool = False) -> DataFrame:
    """(keys, value, n, before): rows of each distinct value, and rows of its key that precede it in order."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order: Column = F.col(value).desc() if descending else F.col(value).asc()
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written once, as the parts of a second range sort might be cut elsewhere
    parts = cut_lineage(counts.repartitionByRange(n, *keys, order).withColumn("_part", F.spark_partition_id()))
    w = W.Window.partitionBy(*keys).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a key and part
    totals = parts.groupBy(*keys, "_part").agg(F.sum("n").alias("_t")).withColumn("_start", F.coalesce(F.sum("_t").over(w), F.lit(0)))
    inner = W.Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(W.Window.unboundedPreceding, -1)
    own = parts.withColumn("_own", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    on = own["_part"] == totals["_part"]
    for k in keys:
        on = on & own[k].eqNullSafe(totals[k])
    joined = own.join(totals, on)
    return joined.select(*[own[k] for k in keys], own[value], own["n"], (own["_own"] + totals["_start"]).alias("before"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each key's non-null values, one column for each named probability."""
    counts = cut_lineage(running_counts(df.where(F.col(value).isNotNull()), keys, value))
    size = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    one = F.lit(1).alias("_k")
    rows = counts.join(size, keys) if keys else counts.select("*", one).join(F.broadcast(size.select("*", one)), "_k")  # one row of sizes
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))
    place = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    ends = [x for name, r in place.items() for x in (at(F.floor(r)).alias(f"_low_{name}"), at(F.ceil(r)).alias(f"_high_{name}"))]
    found = rows.groupBy(*keys, "_n").agg(*ends)
    return found.select(*keys, *[
        (F.col(f"_low_{name}") + (r - F.floor(r)) * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))).alias(name) for name, r in place.items()])
