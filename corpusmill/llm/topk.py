"""The best chunks of each question, by a merge of sorted runs with a loser tree.

Each partition is turned into sorted runs, one per question, cut after the question's k best
chunks: a chunk among the k best of all is among the k best of the partition that holds its
highest score.  The runs of FAN_IN neighbouring partitions make a bucket, whose runs a loser tree
merges into one for each question; another one merges the buckets' runs.  Each merge goes on to
the next question after k chunks, so that no task ever holds all candidates of one question.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted at once; a larger partition gives several runs.
RUN_ROWS = 1 << 20
#: Partitions whose runs make a bucket.
FAN_IN = 64
_END = (float("inf"), float("inf"))
Key = tuple[float, float]


class LoserTree:
    """Merges ascending sequences of keys; each inner node keeps the loser of its match."""

    def __init__(self, runs: Sequence[Sequence[Key]]) -> None:
        self.runs, self.at, n = runs, [0] * len(runs), len(runs)
        self.losers = [0] * max(n, 1)
        winners = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self._beats(b, a) else (a, b)
        self.winner = winners[1] if n > 1 else 0

    def _head(self, run: int) -> tuple[bool, Key]:
        """The run's next key; an exhausted run sorts after every key."""
        at = self.at[run]
        return (False, self.runs[run][at]) if at < len(self.runs[run]) else (True, _END)

    def _beats(self, a: int, b: int) -> bool:
        return self._head(a) < self._head(b)

    def __iter__(self) -> Iterator[Key]:
        if not self.runs:
            return
        while True:
            ended, key = self._head(self.winner)
            if ended:
                return
            yield key
            self.at[self.winner] += 1
            winner, node = self.winner, (self.winner + len(self.runs)) >> 1
            while node:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node >>= 1
            self.winner = winner


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= RUN_ROWS:
            yield _run(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield _run(pa.Table.from_batches(held))


def _run(table: pa.Table) -> pa.RecordBatch:
    questions = table["question_id"].combine_chunks().dictionary_encode()
    q = questions.indices.to_numpy(zero_copy_only=False)
    chunk, score, k = (table[x].to_numpy() for x in ("chunk_id", "score", "k"))
    most = np.zeros(len(questions.dictionary), dtype=np.int64)
    np.maximum.at(most, q, k)
    order = np.lexsort((-score, chunk, q))
    q, chunk, score = q[order], chunk[order], score[order]
    first = np.ones(len(q), dtype=bool)
    first[1:] = (q[1:] != q[:-1]) | (chunk[1:] != chunk[:-1])
    q, chunk, score = q[first], chunk[first], score[first]
    order = np.lexsort((chunk, -score, q))
    q, chunk, score = q[order], chunk[order], score[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    kept = rank < most[q]
    q, chunk, score = q[kept], chunk[kept], score[kept]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.r_[starts, len(q)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            questions.dictionary.take(pa.array(q[starts])),
            pa.array(most[q[starts]]),
            pa.ListArray.from_arrays(offsets, pa.array(score)),
            pa.ListArray.from_arrays(offsets, pa.array(chunk)),
        ],
        names=["question_id", "k", "scores", "chunk_ids"],
    )


def merge_runs(runs: Sequence[tuple[Sequence[float], Sequence[int]]], k: int) -> list[tuple[int, float]]:
    """The k best (chunk, score) of runs sorted by descending score, then chunk; a chunk counts once."""
    best: list[tuple[int, float]] = []
    seen: set[int] = set()
    for minus, chunk in LoserTree([[(-s, c) for s, c in zip(*run)] for run in runs]):
        if len(best) >= k:
            break
        if chunk not in seen:
            seen.add(chunk)
            best.append((chunk, -minus))
    return best


_RUN = "question_id string, k bigint, scores array<double>, chunk_ids array<bigint>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            best = merge_runs([(x["scores"], x["chunk_ids"]) for x in row["runs"]], row["k"])
            out.append((row["question_id"], row["k"], [s for _, s in best], [c for c, _ in best]))
        kinds = {"question_id": pa.string(), "k": pa.int64(), "scores": pa.list_(pa.float64()), "chunk_ids": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _merge(runs: DataFrame, *keys: str) -> DataFrame:
    """One run for each question and other key."""
    of = runs.groupBy("question_id", *keys).agg(F.max("k").alias("k"), F.collect_list(F.struct("scores", "chunk_ids")).alias("runs"))
    return of.select("question_id", "k", "runs").mapInArrow(_merged, _RUN)


def best_chunks(results: DataFrame) -> DataFrame:
    """question_id, chunk_id, score, rank: each question's k best chunks, each with its highest score.

    Equal scores go to the smaller chunk_id.  Rows without question, chunk, score (null or
    NaN) or k don't count; a k below 1 gives nothing, and of different ones the largest holds.
    """
    rows = results.select("question_id", F.col("chunk_id").cast("bigint"), F.col("score").cast("double"), F.col("k").cast("bigint"))
    rows = rows.where("question_id is not null and chunk_id is not null and score is not null and not isnan(score) and k is not null")
    runs = rows.mapInArrow(_sorted_runs, _RUN).withColumn("bucket", F.floor(F.spark_partition_id() / FAN_IN))
    buckets = _merge(runs, "bucket")
    best = _merge(buckets)
    return best.select("question_id", F.posexplode(F.arrays_zip("chunk_ids", "scores")).alias("at", "x")).select("question_id", F.col("x.chunk_ids").alias("chunk_id"), F.col("x.scores").alias("score"), (F.col("at") + 1).alias("rank"))
