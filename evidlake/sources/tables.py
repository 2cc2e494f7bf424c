"""Reading of the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """``<root>/<name>.parquet``; with ``columns``, just these (pruned in the scan)."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
