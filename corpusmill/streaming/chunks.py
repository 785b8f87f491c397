"""Chunks of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.chunking import LIMIT, cut_files
from corpusmill.schemas import FILES


def chunk_stream(spark: SparkSession, folder: str, limit: int = LIMIT) -> DataFrame:
    """The chunks and diagnostics of files that come into the folder as Parquet; cutting keeps no state, so no watermark is needed."""
    return cut_files(spark.readStream.schema(FILES).parquet(folder), limit)


def write_chunks(chunks: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the chunks to Parquet, each file's once, whatever fails in between."""
    writer = chunks.where("kind is null").drop("kind", "message").writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(folder)
