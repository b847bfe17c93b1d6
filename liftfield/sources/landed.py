"""Readers for landed files and the per-source normalisers' shared helpers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], _schema(schema))


def _or_empty(spark: SparkSession, load, schema) -> DataFrame:
    try:
        return load()
    except AnalysisException as e:
        if (e.getCondition() or "") == "PATH_NOT_FOUND":
            return empty(spark, schema)
        raise


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet with a fixed schema; a missing path is an empty table."""
    return _or_empty(spark, lambda: spark.read.schema(_schema(schema)).parquet(path), schema)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a fixed schema, unreadable lines dropped."""
    full = T.StructType([*_schema(schema).fields, T.StructField("_corrupt", T.StringType())])
    lines = _or_empty(spark, lambda: spark.read.text(path), "value string")
    rows = lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("row")).select("row.*")
    return rows.filter("_corrupt IS NULL").drop("_corrupt")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and typed columns; a missing file is an empty table."""
    return _or_empty(
        spark, lambda: spark.read.schema(_schema(schema)).csv(path, header=True, dateFormat="yyyy-MM-dd"), schema
    )


def daily_csv_path(folder: str, source: str) -> str:
    """Analysis inputs keep their own names, every other source is ``{name}_daily.csv``."""
    fixed = ("pre_period", "post_period", "ad_spend")
    return f"{folder}/{source}.csv" if source in fixed else f"{folder}/{source}_daily.csv"


def write_cache(df: DataFrame, folder: str, source: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{source}")


def read_cache(spark: SparkSession, folder: str, source: str, schema: T.StructType | str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{source}", schema)


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Expand a column of raw JSON text into typed columns; unreadable rows are dropped."""
    return (
        df.withColumn("_row", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
        .filter(F.col("_row").isNotNull())
        .select("_row.*")
    )


def number(c: Column | str) -> Column:
    """Double with missing or unreadable text as 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def whole(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def in_window(df: DataFrame, start, end, column: str = "date") -> DataFrame:
    """Inclusive date window; a plain predicate, so it prunes partitions and reaches the scan."""
    return df.filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def only_ids(df: DataFrame, column: str, ids: list[str] | None) -> DataFrame:
    """Optional id filter that reaches the scan as an IN predicate."""
    return df if not ids else df.filter(F.col(column).isin(list(ids)))
