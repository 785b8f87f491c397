"""A session with what the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpusmill", **conf: str) -> SparkSession:
    """The running session, or a new one with adaptive plans and bounded Arrow batches; files hold long texts."""
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m", "spark.sql.files.maxPartitionBytes": "64m", "spark.sql.session.timeZone": "UTC",
    }
    return SparkSession.builder.appName(name).config(map=defaults | conf).getOrCreate()
