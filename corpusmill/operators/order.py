"""Orders that run over all rows, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import path_key
from corpusmill.storage import cut


def numbered(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """The rows with their place, from 0, in the order of the keys, which must tell all rows apart.

    The rows are moved once, into sorted ranges, and written; a place is a row's place in its
    range plus the rows of the ranges before.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_key{i}" for i in range(len(keys))]
    ranges = rows.withColumns(dict(zip(names, keys))).repartitionByRange(parts, *names).sortWithinPartitions(*names).drop(*names)
    held = cut(ranges).withColumn("_at", F.monotonically_increasing_id())  # the range's number, and 33 bits for the place in it
    counts = held.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n"))
    before = counts.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = held.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(before), "_range")
    return placed.withColumn(name, F.col("before") + inside).drop("_range", "_at", "before")


def type_rank(ext: Column) -> Column:
    """Texts come first, then Markdown, then Python."""
    return F.when(ext == "txt", 0).when(ext == "md", 1).when(ext == "py", 2).otherwise(3)


def path_order(files: DataFrame) -> DataFrame:
    """file_path, place: the paths of each kind in the order of their components, kind after kind."""
    paths = files.where("file_path is not null").groupBy("file_path").agg(F.min("ext").alias("ext"))
    return numbered(paths, [type_rank(F.col("ext")), path_key(F.col("file_path")), F.col("file_path")], "place").select("file_path", "place")


def number_chunks(chunks: DataFrame, key: list[Column] | None = None, name: str = "chunk_id") -> DataFrame:
    """The chunks with ids from 0: texts, then Markdown, then Python, by path, then by where they begin."""
    path = F.col("file_path")
    own = key or [F.col("first_character_index"), F.col("last_character_index")]
    return numbered(chunks, [type_rank(F.col("ext")), path_key(path), path, *own], name)
