"""Pieces of over-long chunks, by balanced-target splitting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run's limit where it has none.
DEFAULT_LIMIT = 2000
#: Natural boundaries, the best first; a piece may end where a match ends.
_BOUNDARIES = tuple(re.compile(x) for x in (r"(?:\r\n|\r|\n)(?=[ \t]*(?:@\w|(?:async[ \t]+)?def[ \t]|class[ \t])|#{1,6}[ \t])", r"(?:\r\n|\r|\n)[ \t\f]*(?:\r\n|\r|\n)", r"\r\n|\r|\n|[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", r"(?<=[.!?;:。！？])\s", r"\s"))

#: How far a boundary may look beyond the piece that it ends.
_AHEAD = 100


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans of at most `limit` characters that cover the text, each beginning `overlap` before the last one's end.

    The rest of the text is always shared evenly among the fewest pieces that hold it; a piece
    ends at the best kind of boundary there is between half its target and the limit, at the
    one nearest its target.  Without any boundary it ends at the target.
    """
    limit = max(limit, 1)
    overlap = min(max(overlap, 0), limit - 1)
    spans: list[tuple[int, int]] = []
    start, n = 0, len(text)
    while n - start > limit:
        rest = n - start - overlap
        count = -(-rest // (limit - overlap))
        target = start + overlap + -(-rest // count)
        low, high = max(start + overlap + 1, start + (target - start) // 2), start + limit
        end = target
        for boundary in _BOUNDARIES:
            at = [m.end() for m in boundary.finditer(text, max(low - 2, start), min(high + _AHEAD, n)) if low <= m.end() <= high]
            if at:
                end = min(at, key=lambda x: (abs(x - target), x))
                break
        spans.append((start, end))
        start = end - overlap
    spans.append((start, n))
    return spans


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            {"chunk_id": x["chunk_id"], "piece": i, "first": a, "last": b, "content": x["content"][a:b]}
            for x in batch.to_pylist()
            for i, (a, b) in enumerate(split(x["content"], x["limit"], x["overlap"]))
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("chunk_id", pa.int64()), ("piece", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("content", pa.string())]))


def split_chunks(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """chunk_id, piece, first, last, content: the pieces of every chunk that is longer than its run's limit.

    Offsets are code points within the chunk.  A limit of null is 2000, an overlap of null a
    tenth of the limit; of a run that is given twice, the smaller limit holds.  A chunk without id,
    content or run has no piece; a repeated row gives its pieces again.
    """
    limit = F.coalesce(F.col("max_chunk_size"), F.lit(DEFAULT_LIMIT))
    limits = runs.where("run_id is not null").select("run_id", limit.alias("limit"), F.coalesce(F.col("overlap"), F.floor(limit / 10)).cast("int").alias("overlap"))
    limits = limits.groupBy("run_id").agg(F.min(F.struct("limit", "overlap")).alias("l")).select("run_id", "l.limit", "l.overlap")
    rows = chunks.where("chunk_id is not null").select("chunk_id", "content", "run_id").join(limits, "run_id").where(F.length("content") > F.col("limit"))
    return rows.select("chunk_id", "content", "limit", "overlap").mapInArrow(_pieces, "chunk_id bigint, piece int, first int, last int, content string")
