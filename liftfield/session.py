"""Session defaults, lineage cuts and small join sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "liftfield", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC dates; any setting can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder of our own only in local mode without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="liftfield-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    For small tables that a plan uses many times: computed a single time, and still there after an executor loss.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/liftfield/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """A derived join side, computed once: the written table's size tells the planner whether to broadcast it.

    Keeps joins on few keys (channel, test) from shuffling the large side into as few tasks while that size is small;
    beyond the planner's limit the join is shuffled and adaptive execution splits skewed keys.
    """
    return cut_lineage(df)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-spread a few rows that are about to be exploded; a stated count is never coalesced by AQE."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1), *cols)


def with_grand(df: DataFrame, **aggregates) -> DataFrame:
    """Add whole-table aggregates to every row: a one-row broadcast, never a single-task window."""
    one = df.agg(*[c.alias(n) for n, c in aggregates.items()]).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").drop("_k")
