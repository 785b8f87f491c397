"""Line and paragraph spans as relational operators; spans are half-open, in code points.

The text of a line is dropped before rows are moved: only offsets are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.storage import spread


def _lines(files: DataFrame) -> DataFrame:
    """row, file_path, line, first, last, full_last, blank of every line; `row` tells files of one path apart."""
    held = spread(files.where("content is not null").select("file_path", "content")).select(F.monotonically_increasing_id().alias("row"), "file_path", "content")
    pieces = held.select("row", "file_path", F.posexplode(T.lines(F.col("content"))).alias("line", "piece"))
    piece = F.col("piece")
    sizes = pieces.select("row", "file_path", "line", F.length(piece).alias("size"), F.length(T.without_end(piece)).alias("kept"), T.is_blank(piece).alias("blank"))
    first = F.coalesce(F.sum("size").over(Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return sizes.withColumn("first", first).select("row", "file_path", "line", "first", (F.col("first") + F.col("kept")).alias("last"), (F.col("first") + F.col("size")).alias("full_last"), "blank")


def line_spans(files: DataFrame) -> DataFrame:
    r"""file_path, line, first, last: the lines of each file, without \r and \n at their ends.

    Lines end where str.splitlines() ends them.  A file without content, or an empty one, has
    none; the same content under one path counts once.
    """
    return _lines(files).select("file_path", "line", "first", "last").distinct()


def paragraph_spans(files: DataFrame) -> DataFrame:
    """file_path, first, last: each longest run of lines that aren't blank."""
    rows = _lines(files)
    island = F.sum(F.col("blank").cast("int")).over(Window.partitionBy("row").orderBy("line"))
    of = rows.withColumn("island", island).where("not blank").groupBy("row", "file_path", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return of.select("file_path", "first", "last").distinct()


def line_marks(files: DataFrame) -> DataFrame:
    """file_path, line, fence_char, fence_len, header: what each line could be in Markdown, wherever it stands."""
    rows = spread(files.where("content is not null").select("file_path", "content")).select("file_path", F.posexplode(T.lines(F.col("content"))).alias("line", "piece"))
    line = T.without_end(F.col("piece"))
    return rows.select("file_path", "line", T.fence(line).alias("fence"), T.is_header(line).alias("header")).select("file_path", "line", "fence.fence_char", "fence.fence_len", "header").distinct()


def text_windows(texts: DataFrame, key: str, column: str, limit: int, overlap: int | None = None) -> DataFrame:
    """key, first, last: overlapping windows over each text; the overlap is a tenth of the limit where none is given."""
    overlap = limit // 10 if overlap is None else overlap
    spans = T.window_spans(F.lit(0), F.length(column), limit, overlap)
    return texts.where(F.col(column).isNotNull()).select(key, F.inline(spans))
