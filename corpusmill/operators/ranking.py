"""The best chunks of each question, without a row for each chunk that shares a term with a question.

Such pairs grow with questions times chunks.  Terms are numbered by the questions' vocabulary, so
that a chunk is a short list of numbers.  Chunks are dealt into blocks of about POSTINGS postings
and questions into groups; a task inverts one block, answers one group from it and gives only each
question's k best chunks of the block, from which the k best of all are taken.

In a block, a question's terms are added up from the most frequent to the rarest, and questions are
taken in the order of these terms, so that those that begin with the same terms share their sums.
One more term changes only the chunks that have it: the k best are among them and the k best before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that scores are rounded to before they are compared, as sums of doubles depend on their order.
PLACES = 6
#: Postings of a block; a task holds a block with some 100 bytes for each.
POSTINGS = 4_000_000
#: Questions of a group, at most and, but for the last, at least.
GROUP, LEAST_GROUP = 100_000, 500


def vocabulary(words: DataFrame) -> pa.Array:
    """The distinct terms of rows with `terms`, in order; they go to the driver and to every task."""
    return words.select(F.explode("terms").alias("term")).distinct().toArrow()["term"].combine_chunks().cast(pa.string()).sort()


def numbered(words: DataFrame, terms: pa.Array) -> DataFrame:
    """The first column of (id, terms), length, terms, times: the numbers of a row's terms in the vocabulary and how often it has each; `length` counts other words, too."""
    shared = words.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(pc.index_in(batch.column(1).flatten().cast(pa.string()), known), -1).to_numpy(zero_copy_only=False)
            kept = ids >= 0
            both, times = np.unique(np.repeat(np.arange(len(lengths)), lengths)[kept] * max(len(known), 1) + ids[kept], return_counts=True)
            row, term = np.divmod(both, max(len(known), 1))
            starts = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), *lists], ["id", "length", "terms", "times"])

    key = words.columns[0]
    return words.select(F.col(key).alias("id"), "terms").mapInArrow(rows, f"id {dict(words.dtypes)[key]}, length int, terms array<int>, times array<int>").withColumnRenamed("id", key)


def frequencies(held: DataFrame, n: int) -> np.ndarray:
    """In how many rows each of the vocabulary's n terms occurs."""
    table = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    df = np.zeros(n, np.int64)
    df[table["term"].to_numpy()] = table["count"].to_numpy()
    return df


class Block:
    """Chunks and their scores, by term; place[t] is a term's place in the order in which scores are added up."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, scores: np.ndarray, n_docs: int, place: np.ndarray, k: int) -> None:
        self.k, self.sums, self.seen = k, np.zeros(n_docs), np.zeros(n_docs, bool)
        key = place[terms] * np.int64(n_docs) + docs
        order = np.argsort(key, kind="stable")
        key, scores = key[order], scores[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        if len(first) < len(key):  # a chunk that is given twice
            key, scores = key[first], np.add.reduceat(scores, first)
        at, self.docs = np.divmod(key, n_docs)
        self.scores, self.starts = scores, np.searchsorted(at, np.arange(len(place) + 1))
        #: The terms that are added up: each with its chunks, their sums before, and the best chunks with it and their scores.
        self.path: list[tuple] = []

    def best(self, bag: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
        """The k best chunks and their scores in units of the last place, for the places of terms, in ascending order, and how often each counts."""
        same = 0
        while same < min(len(bag), len(self.path)) and self.path[same][0] == bag[same]:
            same += 1
        while len(self.path) > same:
            _, docs, old, _, _ = self.path.pop()
            self.sums[docs] = old
        for term in bag[same:]:
            self._add(term)
        _, _, _, docs, scores = self.path[-1]
        return docs[scores > 0], scores[scores > 0]

    def _add(self, term: tuple[int, int]) -> None:
        (t, times), k, sums = term, self.k, self.sums
        docs, scores = self.docs[self.starts[t] : self.starts[t + 1]], self.scores[self.starts[t] : self.starts[t + 1]]
        old = sums[docs]
        new = old + (scores * times if times > 1 else scores)
        sums[docs] = new
        found, values = docs, new
        if self.path:
            *_, top, scored = self.path[-1]
            if len(top) == k:
                high = new >= (scored[-1] - 1) / 10**PLACES  # lower ones aren't even rounded to the last of the best
                found, values = docs[high], new[high]
            self.seen[top] = True
            other = ~self.seen[found]
            self.seen[top] = False
            found, values = np.concatenate((top, found[other])), np.concatenate((sums[top], values[other]))
        values = np.rint(values * 10**PLACES)
        if len(values) > 4 * k:
            kept = values >= np.partition(values, len(values) - k)[len(values) - k]
            found, values = found[kept], values[kept]
        order = np.lexsort((found, -values))[:k]
        self.path.append((term, docs, old, found[order], values[order]))


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _answered(chunks: pa.Table, questions: pa.Table, k: int, place: np.ndarray, score: Callable | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The number, the chunk's row and the score of the k best chunks of each question."""
    lengths = pc.list_value_length(chunks["terms"]).to_numpy().astype(np.int64)
    ids = chunks["chunk_id"].combine_chunks()
    firsts = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)  # a chunk that is given twice is one
    n_docs = int(firsts.max()) + 1
    rows = np.zeros(n_docs, np.int64)
    rows[firsts[::-1]] = np.arange(len(firsts))[::-1]
    terms, values = _flat(chunks["terms"]), _flat(chunks["values"])
    if score is not None:
        values = score(terms, values, np.repeat(chunks["length"].to_numpy(), lengths))
    block = Block(np.repeat(firsts, lengths), terms, values, n_docs, place, k)
    lengths = pc.list_value_length(questions["terms"]).to_numpy().astype(np.int64)
    owner, places, times = np.repeat(np.arange(len(lengths)), lengths), place[_flat(questions["terms"])], _flat(questions["times"])
    kept = block.starts[places + 1] > block.starts[places]
    owner, places, times = owner[kept], places[kept], times[kept]
    order = np.lexsort((places, owner))
    pairs, starts = list(zip(places[order].tolist(), times[order].tolist())), np.searchsorted(owner, np.arange(len(lengths) + 1)).tolist()
    bags: dict[tuple, list[int]] = {}  # many questions differ only in words that no chunk has
    for i in range(len(lengths)):
        if starts[i] < starts[i + 1]:
            bags.setdefault(tuple(pairs[starts[i] : starts[i + 1]]), []).append(i)
    own, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
    for bag in sorted(bags):
        found, scored = block.best(bag)
        for i in bags[bag]:
            own.append((i, len(found)))
            docs.append(found)
            scores.append(scored)
    own = np.array(own, np.int64).reshape(-1, 2)
    return questions["number"].take(pa.array(np.repeat(own[:, 0], own[:, 1]))).combine_chunks(), rows[np.concatenate(docs)], np.concatenate(scores) / 10**PLACES


def best(held: DataFrame, asked: DataFrame, k: int, df: np.ndarray, score: Callable | None = None) -> DataFrame:
    """number, chunk_id, score: the k best chunks of every block for each question.

    held: chunk_id, length, terms, values; a chunk is in one block.  asked: number, terms, times.
    df: in how many chunks each term is.  score: makes scores of terms, values and lengths.
    """
    spark = held.sparkSession
    blocks, n = max(1, math.ceil(int(df.sum()) / POSTINGS)), asked.count()
    groups = max(1, math.ceil(n / GROUP), min(math.ceil(spark.sparkContext.defaultParallelism / blocks), n // LEAST_GROUP))
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    shared, kind = spark.sparkContext.broadcast(place), dict(held.dtypes)["chunk_id"]

    def rows(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        names = ["number", "chunk_id", "score"]
        if not chunks.num_rows or not questions.num_rows:
            return pa.table([questions["number"].slice(0, 0), chunks["chunk_id"].slice(0, 0), pa.array([], pa.float64())], names)
        chunks = chunks.take(pc.sort_indices(chunks["chunk_id"]))  # of equal scores, the smaller chunk id comes first
        numbers, at, scores = _answered(chunks, questions, k, shared.value, score)
        return pa.table([numbers, chunks["chunk_id"].take(pa.array(at)), pa.array(scores)], names)

    cell = F.col("block") * groups + F.col("group")
    left = held.where(F.col("chunk_id").isNotNull() & (F.size("terms") > 0)).select(F.pmod(F.hash("chunk_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "*").withColumn("cell", cell).drop("block", "group")
    right = asked.where(F.size("terms") > 0).select(F.pmod(F.hash("number"), F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*").withColumn("cell", cell).drop("block", "group")
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(rows, f"number bigint, chunk_id {kind}, score double")
