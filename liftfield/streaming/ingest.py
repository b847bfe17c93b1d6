"""Daily spend as an incremental stream that can be re-run safely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SPEND_EVENTS = "event_id bigint, ts timestamp, geo string, channel string, spend double"


def daily_totals(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("date"), "geo", "channel").agg(
        F.sum("spend").alias("spend"), F.count("*").alias("n_events"))


def partitions(spark: SparkSession, path: str, days: list, tail: str = "") -> list[str]:
    """Folders of these days that exist."""
    names = ["__HIVE_DEFAULT_PARTITION__" if d is None else str(d) for d in days]
    found = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={n}{tail}") for n in names]
    return [p.toString() for p in found if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]


def ingest_daily(
    events: DataFrame, raw_path: str, totals_path: str, checkpoint: str
) -> StreamingQuery:
    """Write new events once and refresh the totals of the days they touch.

    All tables lie by day first, then by batch. A batch reads the event ids of the days it touches, to tell what is
    new, and the sums that each batch has left for those days; nothing else of the history is opened or listed. Every
    write replaces whole partitions, and a batch looks at lower batch numbers only, so one that runs again after a
    failure leaves the same tables. A late event, however late, refreshes its own day; copies of an event, which carry
    the same time, count once. An event without a time is told from its copies within its batch only. A heavy day is
    split into as many files as its size asks for.
    """
    sums_path = f"{totals_path}-by-batch"

    def replace(df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = batch.withColumn("date", F.to_date("ts")).withColumn("batch", F.lit(batch_id).cast("bigint")).dropDuplicates(["event_id"])
        replace(stamped.hint("rebalance", "date"), raw_path, "date", "batch")
        days = [r["date"] for r in batch.select(F.to_date("ts").alias("date")).distinct().collect()]  # the batch's days
        if not days:
            return

        def read(path: str, schema, tail: str = "") -> DataFrame | None:
            found = partitions(spark, path, days, tail)
            return spark.read.schema(schema).option("basePath", path).parquet(*found) if found else None

        new = read(raw_path, stamped.schema, f"/batch={batch_id}")
        earlier = read(raw_path, stamped.schema)
        seen = earlier.filter(F.col("batch") < batch_id).select("date", "event_id")
        fresh = new.join(seen, ["date", "event_id"], "left_anti")
        sums = daily_totals(fresh).withColumn("batch", F.lit(batch_id).cast("bigint"))
        replace(sums.repartition("date"), sums_path, "date", "batch")
        left = read(sums_path, sums.schema)
        if left is not None:
            totals = left.groupBy("date", "geo", "channel").agg(F.sum("spend").alias("spend"), F.sum("n_events").alias("n_events"))
            replace(totals.repartition("date"), totals_path, "date")

    return (
        events.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_event_stream(spark: SparkSession, folder: str, schema: str = SPEND_EVENTS, pattern: str | None = None, files: int | None = None) -> DataFrame:
    """Events of a folder, at most ``files`` new files a batch."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)
