"""Readers for the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read table `name` below `sf_dir`; only Spark's reader touches the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
