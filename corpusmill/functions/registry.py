"""The cutting of one text as a table function for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusmill.operators.chunking import checked_limit, spans_of


@udtf(returnType="position int, first int, last int, content string")
class ChunkSpans:
    """chunk_spans(content, ext, limit): the chunks of a text; nothing for null."""

    def eval(self, content: str, ext: str, limit: int):
        if content is not None and ext is not None:
            for i, (first, last) in enumerate(spans_of(content, ext, checked_limit(limit))[0]):
                yield i, first, last, content[first:last]


def register(spark: SparkSession) -> None:
    """Makes chunk_spans known: select ... from files, lateral chunk_spans(content, ext, 2000)."""
    spark.udtf.register("chunk_spans", ChunkSpans)
