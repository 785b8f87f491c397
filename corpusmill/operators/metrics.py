"""Sizes of chunks by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_metrics(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """ext, n_chunks, n_files, chunks_per_file, min_size, max_size, avg_size, median_size of every kind that has chunks.

    All files of a kind count, also those without a chunk; a path that was scanned again counts
    once.  The median is exact.
    """
    size = F.col("last_character_index") - F.col("first_character_index")
    sizes = chunks.where(size.isNotNull()).select("ext", size.alias("size"))
    of = sizes.groupBy("ext").agg(F.count("*").alias("n_chunks"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.round(F.avg("size"), 6).alias("avg_size"), F.median("size").alias("median_size"))
    held = files.select("file_path", "ext").distinct().groupBy("ext").agg(F.count("*").alias("n_files"))
    return of.join(held, "ext").withColumn("chunks_per_file", F.round(F.col("n_chunks") / F.col("n_files"), 6))
