"""Readers of the parquet tables, one folder or file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` under ``base``; columns are pruned by the query that follows."""
    return spark.read.parquet(f"{base}/{name}.parquet")
