"""Parquet tables in one folder, one file or directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``<folder>/<name>.parquet``; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
