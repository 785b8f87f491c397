"""Held-out passages inside documents, by Wu-Manber search over words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import spread

#: Characters of items that are searched for at once.
BLOCK = 50_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters or digits, in lower case."""
    if text.isascii():
        return _WORD.findall(text.lower())
    return [x.lower() for x in _WORD.findall(text)]  # lower case can change what is a letter


class Passages:
    """All windows of `least` consecutive words of the items, in Wu-Manber's tables.

    Blocks are two words.  `shift` has, for each block of a window, the distance from its
    nearest end to the window's end; another block lets the search skip least - 1 words.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], least: int = 12) -> None:
        self.least = least
        self.shift: dict[tuple[str, str], int] = {}
        self.windows: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for item, text in items:
            w = words(text or "")
            for end in range(least, len(w) + 1):
                window = tuple(w[end - least : end])
                if window not in self.windows:
                    for i in range(1, least):
                        block = (window[i - 1], window[i])
                        self.shift[block] = min(self.shift.get(block, least), least - 1 - i)
                self.windows[window].add(item)

    def found(self, text: str) -> set[int]:
        """The items of which the text holds at least `least` consecutive words."""
        w, least, items = words(text), self.least, set()
        at, n, skip, shift, windows = least - 1, len(w), least - 1, self.shift, self.windows
        while at < n:
            step = shift.get((w[at - 1], w[at]), skip)
            if not step:
                hit = windows.get(tuple(w[at + 1 - least : at + 1]))
                if hit:
                    items |= hit
                step = 1
            at += step
        return items


def contaminated(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, item_id: the documents that hold at least `least` consecutive words of an item.

    Items are searched for in blocks of at most BLOCK characters, each in one pass over the
    documents, so that what goes to every executor is bounded.  Rows without an id or text, and
    items of fewer words, give nothing; other columns are ignored.
    """
    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = held.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK) or 1
    found = None
    for block in range(blocks):
        part = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = _searched(documents, [(x.item_id, x.text) for x in part.collect()], least)  # about BLOCK characters
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def _searched(documents: DataFrame, items: list[tuple[int, str]], least: int) -> DataFrame:
    passages = documents.sparkSession.sparkContext.broadcast(Passages(items, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = passages.value
        for batch in batches:
            hits = [(d, i) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for i in sorted(tables.found(t))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], names=["doc_id", "item_id"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return spread(texts).mapInArrow(search, "doc_id bigint, item_id bigint")
