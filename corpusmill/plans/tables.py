"""Readers of the driver's tables, and column types that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(rows: DataFrame) -> DataFrame:
    """The rows with all whole numbers as bigint."""
    return rows.select(*[F.col(c).cast("bigint").alias(c) if kind in ("tinyint", "smallint", "int") else F.col(c) for c, kind in rows.dtypes])
