"""Parquet tables by name under a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waraq.shared import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` stored as ``<folder>/<name>.parquet`` (a file or a folder of parts)."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
