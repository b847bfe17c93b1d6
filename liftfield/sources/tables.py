"""Warehouse tables: schemas, append and overwrite sinks, stores of saved records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftfield.functions.scalars import zip_prefix
from liftfield.operators.latest import latest_per_key
from liftfield.sources.landed import read_json, read_parquet

# Column, type, whether it is required.
RAW_SCHEMAS: dict[str, list[tuple[str, str, bool]]] = {
    "daily_spend": [
        ("loaded_at", "timestamp", True),
        ("date", "date", True),
        ("channel", "string", True),
        ("geo", "string", True),
        ("geo_name", "string", False),
        ("spend", "double", True),
        ("impressions", "bigint", False),
        ("reach", "bigint", False),
        ("frequency", "double", False),
        ("cpm", "double", False),
    ],
    "store_revenue": [
        ("loaded_at", "timestamp", True),
        ("date", "date", True),
        ("order_id", "string", True),
        ("geo", "string", False),
        ("geo_name", "string", False),
        ("gross_revenue", "double", True),
        ("discounts", "double", False),
        ("returns", "double", False),
        ("net_revenue", "double", True),
        ("units", "bigint", False),
        ("new_customer", "boolean", False),
        ("product_category", "string", False),
    ],
    "marketplace_revenue": [
        ("loaded_at", "timestamp", True),
        ("date", "date", True),
        ("item", "string", False),
        ("product_name", "string", False),
        ("gross_revenue", "double", True),
        ("returns", "double", False),
        ("net_revenue", "double", True),
        ("units", "bigint", False),
        ("marketplace", "string", False),
    ],
    "attribution": [
        ("loaded_at", "timestamp", True),
        ("date", "date", True),
        ("channel", "string", True),
        ("model", "string", True),
        ("attributed_revenue", "double", False),
        ("attributed_orders", "double", False),
        ("attributed_new_customers", "double", False),
        ("spend", "double", False),
        ("iroas", "double", False),
    ],
    "calibration_events": [
        ("loaded_at", "timestamp", True),
        ("channel", "string", True),
        ("test_type", "string", True),
        ("test_start_date", "date", True),
        ("test_end_date", "date", True),
        ("lift_abs", "double", True),
        ("lift_lower_90", "double", False),
        ("lift_upper_90", "double", False),
        ("spend_in_period", "double", True),
        ("implied_roi", "double", False),
        ("outcome", "string", True),
        ("geo_scope", "string", False),
        ("notes", "string", False),
        ("ingested_at", "timestamp", False),
    ],
}


def table_schema(name: str) -> T.StructType:
    return T.StructType([
        T.StructField(column, T.StructType.fromDDL(f"{column} {kind}").fields[0].dataType, not required)
        for column, kind, required in RAW_SCHEMAS[name]])


def required_columns(name: str) -> list[str]:
    return [f.name for f in table_schema(name).fields if not f.nullable]


def stamp_load(df: DataFrame) -> DataFrame:
    """Add the UTC load time that every append carries."""
    return df.withColumn("loaded_at", F.current_timestamp())


def append_rows(df: DataFrame, path: str, name: str, partition: str | None = "date") -> None:
    """Append to a table in its own schema; missing nullable columns are written as NULL."""
    stamped = stamp_load(df)
    cols = [
        (F.col(f.name) if f.name in stamped.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table_schema(name).fields
    ]
    writer = stamped.select(*cols).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_parquet(spark, path, table_schema(name))


def load_summary(df: DataFrame, amount: str) -> DataFrame:
    """Rows written and their total, one row per load."""
    return df.agg(
        F.count("*").alias("rows_written"), F.coalesce(F.sum(amount), F.lit(0.0)).alias(f"total_{amount}")
    )


def contract_breaches(df: DataFrame, name: str) -> DataFrame:
    """NULL count of each required column that is present, in one pass."""
    cols = [c for c in required_columns(name) if c in df.columns]
    counts = df.agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    return counts.unpivot("n_rows", cols, "column_name", "null_count")


# ---- stores of saved designs, results and reports -------------------------------------------

STORE_SCHEMA = "test_id string, name string, status string, saved_at timestamp"


def list_store(spark: SparkSession, folder: str, schema: str = STORE_SCHEMA) -> DataFrame:
    """Saved records, unreadable ones skipped."""
    return read_json(spark, folder, schema)


def with_status(store: DataFrame, status: str | None) -> DataFrame:
    return store if status is None else store.filter(F.col("status") == status)


def latest_saved(store: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest record per key."""
    return latest_per_key(store, keys, order)


def save_record(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def report_rows(report: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """A wide report as (key, metric, value) text rows."""
    text = report.select(key, *[F.col(m).cast("string").alias(m) for m in metrics])
    return text.unpivot(key, metrics, "metric", "value")


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    if kind == "csv":
        rows.write.mode("overwrite").csv(path, header=True)
    else:
        rows.write.mode("overwrite").json(path)


# ---- calibration store ----------------------------------------------------------------------


def add_events(df: DataFrame, path: str) -> None:
    append_rows(df, path, "calibration_events", partition=None)


def replace_events(df: DataFrame, path: str) -> None:
    stamped = stamp_load(df)
    cols = [
        (F.col(f.name) if f.name in stamped.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table_schema("calibration_events").fields
    ]
    stamped.select(*cols).write.mode("overwrite").parquet(path)


def clear_events(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], table_schema("calibration_events")).write.mode("overwrite").parquet(path)


# ---- market dimension -----------------------------------------------------------------------


def markets_in(dim: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Dimension rows for a code, a region or a list of codes."""
    return dim.filter(F.col(column).isin(list(values)))


def zip3_table(pairs: DataFrame) -> DataFrame:
    """(zip, geo) rows reduced to one row per 3-character prefix."""
    return (
        pairs.select(zip_prefix(F.col("zip")).alias("zip3"), "geo")
        .filter("zip3 IS NOT NULL")
        .groupBy("zip3")
        .agg(F.min("geo").alias("geo"))
    )


# ---- adjacency ------------------------------------------------------------------------------

ADJACENCY_JSON = "geo string, neighbours array<string>"


def edges_from_lists(lists: DataFrame) -> DataFrame:
    """(geo, neighbours[]) → one row per directed edge, self loops dropped."""
    return (
        lists.select(F.col("geo").alias("src"), F.explode("neighbours").alias("dst"))
        .filter("src <> dst")
        .distinct()
    )


def read_adjacency(spark: SparkSession, path: str, centroids: DataFrame, source: str = "file") -> DataFrame:
    """Edges of the file (``source`` "file") or of centroid distance ("centroids"); the caller decides, not the file's size."""
    from liftfield.operators.spillover import centroid_edges

    if source not in ("file", "centroids"):
        raise ValueError("source is file or centroids")
    if source == "file":
        return edges_from_lists(read_json(spark, path, ADJACENCY_JSON))
    return centroid_edges(centroids).select("src", "dst")


def neighbours_of(edges: DataFrame, geo: str) -> DataFrame:
    return edges.filter(F.col("src") == geo).select("dst").distinct()
