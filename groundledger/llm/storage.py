"""The given tables, and the shared storage of the library's other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import release, settle, shared_dir, unused

__all__ = ["release", "settle", "shared_dir", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
