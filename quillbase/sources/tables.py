"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
