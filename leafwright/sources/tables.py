"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table `name` of the folder `sf_dir`; with `columns`, only these are read.

    Columns that a table has beyond those asked for are pruned at the scan, so
    clashing extra columns never reach an operator.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
