"""Readers for the driver's parquet tables and for the library's own tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table_or_empty(spark: SparkSession, name: str, schema) -> DataFrame:
    """O-02: a catalog table if it exists, else an empty frame with the schema."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """O-05: replace or append a parquet table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """O-13: result tables (metrics, summaries) written as JSON or Parquet; the
    tables are small by construction, so a single file is written."""
    df.coalesce(1).write.mode("overwrite").format(fmt).save(path)
