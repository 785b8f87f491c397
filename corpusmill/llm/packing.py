"""Documents packed into context windows, by the minimum bin slack heuristic.

Per window, a subset-sum table (one bit for each fill) over the lengths still to be placed gives
the fullest feasible combination, which is then removed.  Shards of a bounded number of items
are packed independently; what lies in windows with room left is packed again, in fewer shards,
until one shard is left or nothing changes.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a public byte-level BPE cuts texts before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a shard, at most about so many.
SHARD_ITEMS = 20_000
#: A window that is filled to this share isn't packed again.
FULL = 0.999
#: Longer texts are tokenized in parts of about this length; a part without a line end is cut anywhere.
_RUN = 100_000
_ITEMS = "doc_id bigint, part int, first_token int, tokens int"


def fill(lengths: Sequence[int], counts: Sequence[int], room: int) -> tuple[int, list[int]]:
    """The fullest sum of at most `room`, with how often each length is taken.

    Lengths are in descending order.  Bit s of the table is set if the lengths so far make s; the
    search ends as soon as `room` itself is made.
    """
    table, tables, target = 1, [], 1 << room
    mask = (target << 1) - 1
    for length, count in zip(lengths, counts):
        tables.append(table)
        if length <= room:
            left, step = min(count, room // length) if length else 0, 1
            while left > 0:  # 1, 2, 4, ... copies make every number of them
                step = min(step, left)
                table |= table << length * step & mask
                left -= step
                step *= 2
        if table & target:
            break
    total = table.bit_length() - 1
    taken, rest = [0] * len(lengths), total
    for i in range(len(tables) - 1, -1, -1):
        length = lengths[i]
        while length and not tables[i] >> rest & 1:
            rest -= length
            taken[i] += 1
    return total, taken


def pack(items: Sequence[tuple[int, object]], capacities: Sequence[int]) -> list[tuple[int, list[object]]]:
    """Windows as (capacity, members): each item (length, member) once, none over its capacity.

    The longest item left opens a window; it gets the capacity, and the fullest combination of
    other items, that leaves the least share of room.  Items of no length go to the last window.
    """
    of: dict[int, list[object]] = {}
    for length, member in items:
        of.setdefault(length, []).append(member)
    empty = of.pop(0, [])
    lengths = sorted(of, reverse=True)
    sizes = sorted(set(capacities), reverse=True)
    windows: list[tuple[int, list[object]]] = []
    while lengths:
        seed = lengths[0]
        members = [of[seed].pop()]
        if not of[seed]:
            lengths.pop(0)
        counts = [len(of[x]) for x in lengths]
        best = None
        for size in sizes:
            if size < seed:
                break
            start = bisect.bisect_left(lengths, -(size - seed), key=lambda x: -x)
            total, taken = fill(lengths[start:], counts[start:], size - seed)
            slack = (size - seed - total) / size
            if best is None or slack < best[0]:
                best = (slack, size, start, taken)
            if not slack:
                break
        if best is None:
            raise ValueError("an item is longer than every capacity")
        _, size, start, taken = best
        used = [(lengths[start + i], k) for i, k in enumerate(taken) if k]
        for length, k in used:
            members += of[length][-k:]
            del of[length][-k:]
        lengths = [x for x in lengths if of[x]] if used else lengths
        windows.append((size, members))
    if empty:
        if not windows:
            windows.append((sizes[-1], []))
        windows[-1][1].extend(empty)
    return windows


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoding, text: str) -> int:
    """Tokens of the whole text.  A long one is cut before line ends that no white space follows, where no token reaches across."""
    if len(text) <= _RUN:
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    while len(text) - at > _RUN:
        end = at + _RUN
        while (end := text.rfind("\n", at + 1, end)) > 0 and text[end + 1].isspace():
            pass
        end = end if end > 0 else at + _RUN
        total += len(encoding.encode_ordinary(text[at:end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def items_of(documents: DataFrame, largest: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, part, first_token, tokens: each text as one item, or, if longer than the largest capacity, as full parts and a rest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                n = count_tokens(encoding, text)
                out += [(doc, i, i * largest, min(largest, n - i * largest)) for i in range(max(1, -(-n // largest)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "part", "first_token", "tokens"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return spread(texts).mapInArrow(rows, _ITEMS)


def _shard(turn: int, capacities: Sequence[int]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs the items of one shard."""

    def rows(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        members = frame.sort_values(["tokens", "doc_id", "part"])[["doc_id", "part", "first_token", "tokens"]].itertuples(index=False, name=None)
        out = []
        for i, (size, held) in enumerate(pack([(x[3], x) for x in members], capacities)):
            filled = sum(x[3] for x in held)
            out += [(f"{turn}-{key[0]}-{i}", size, filled, *x) for x in held]
        return pd.DataFrame(out, columns=["window", "capacity", "filled", "doc_id", "part", "first_token", "tokens"])

    return rows


def packed(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """window, capacity, filled, doc_id, part, first_token, tokens: the window that each text, or part of a text, goes to.

    `window` is a string, unique per window.  Capacities that are null or not positive aren't
    used; without any there is no result.  Null texts and ids have no row, an empty text has one
    with no tokens, and a repeated row is placed once for each time it occurs.
    """
    capacities = sorted({int(x.capacity) for x in containers.select("capacity").where("capacity > 0").distinct().collect()})  # a few kinds
    schema = "window string, capacity int, filled int, " + _ITEMS
    if not capacities:
        return documents.sparkSession.createDataFrame([], schema)
    items = cut(items_of(documents, capacities[-1], tokenizer))
    done, turn, left = [], 0, items.count()
    while True:
        shards = max(1, -(-left // SHARD_ITEMS))

        placed = cut(items.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_shard(turn, capacities), schema))
        if shards == 1:
            done.append(placed)
            break
        full = F.col("filled") >= FULL * F.col("capacity")
        items = placed.where(~full).select("doc_id", "part", "first_token", "tokens")
        before, left = left, items.count()
        if left > before // 2:
            done.append(placed)  # packing again wouldn't gain
            break
        done.append(placed.where(full))
        turn += 1
        if not left:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
