"""Passages that chunks share word for word, by Rabin-Karp hashes of windows.

Windows are of code points, as a passage may begin and end inside a token.  Of the windows of
ANCHOR characters, those with the least hash among their neighbours are kept, so that any two
equal passages of LEAST characters keep an equal one; chunks that keep one in common are then
compared by all their windows of LEAST characters.  Copies of a chunk make a class, and only
classes are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import cut, spread

LEAST, ANCHOR = 200, 100
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters that are hashed at once.
_SLAB = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, _SLAB), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def window_hashes(text: str, width: int) -> np.ndarray:
    """The hash of each window of `width` code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    h = (sums[width:] - sums[:-width]) * _power(_INVERSE, n - width + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(texts: list[str]) -> list[np.ndarray]:
    """The distinct hashes that each text keeps."""
    width = LEAST - ANCHOR + 1
    lengths = np.array([len(x) for x in texts])
    ends = np.cumsum(lengths)
    h = window_hashes("".join(texts), ANCHOR)
    if len(h) < width:
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    least = _sliding(h, width, np.minimum)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    least[np.arange(len(least)) + LEAST > ends[owner]] = 0  # windows across two texts
    edge = np.zeros(width - 1, dtype=np.uint64)
    kept = _sliding(np.concatenate([edge, least, edge]), width, np.maximum)[: len(h)] == h
    at = np.flatnonzero(kept)
    cuts = np.searchsorted(at, ends[:-1])
    return [np.unique(h[x]) for x in np.split(at, cuts)]


def shared_spans(a: str, b: str, hashes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The parts of a that lie in passages of at least LEAST characters which b has too, and those of b."""
    if a == b and len(a) >= LEAST:
        return [(0, len(a))], [(0, len(b))]
    ha, hb = hashes or (window_hashes(a, LEAST), window_hashes(b, LEAST))
    both = np.intersect1d(ha, hb)
    if not len(both):
        return [], []
    at_a, at_b = np.flatnonzero(np.isin(ha, both)), np.flatnonzero(np.isin(hb, both))
    in_a, in_b = ({x[i : i + LEAST] for i in at.tolist()} for x, at in ((a, at_a), (b, at_b)))  # equal hashes aren't proof
    return tuple(_union([i for i in at.tolist() if x[i : i + LEAST] in other]) for x, at, other in ((a, at_a, in_b), (b, at_b, in_a)))


def _union(starts: Iterable[int]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for i in starts:
        if spans and i <= spans[-1][1]:
            spans[-1] = (spans[-1][0], i + LEAST)
        else:
            spans.append((i, i + LEAST))
    return spans


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        kept = anchors(texts)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64)), pa.array(np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in kept]))], names=["anchor", "chunk_id"])

    for batch in batches:
        ids, texts, size = [], [], 0
        for i, text in zip(batch["chunk_id"].to_pylist(), batch["content"].to_pylist()):
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= _SLAB:
                yield rows(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield rows(ids, texts)


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        known: dict[int, np.ndarray] = {}
        for x in batch.to_pylist():
            a, b = x["content_a"], x["content_b"]
            hashes = None
            if a != b:
                for i, text in ((x["chunk_id_a"], a), (x["chunk_id_b"], b)):
                    if i not in known:
                        if len(known) > 500:
                            known.clear()
                        known[i] = window_hashes(text, LEAST)
                ha = known.get(x["chunk_id_a"])
                hashes = (window_hashes(a, LEAST) if ha is None else ha, known[x["chunk_id_b"]])
            spans = shared_spans(a, b, hashes)
            if spans[0]:
                out.append({"chunk_id_a": x["chunk_id_a"], "chunk_id_b": x["chunk_id_b"], "length_a": len(a), "length_b": len(b)} | {k: [{"first": p, "last": q} for p, q in s] for k, s in zip(("spans_a", "spans_b"), spans)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("chunk_id_a", pa.int64()), ("chunk_id_b", pa.int64()), ("length_a", pa.int32()), ("length_b", pa.int32()), ("spans_a", _SPANS), ("spans_b", _SPANS)]))


def _texts(chunks: DataFrame) -> DataFrame:
    rows = chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("content").cast("string").alias("content"))
    return spread(rows.where((F.length("content") >= LEAST) & F.col("chunk_id").isNotNull()))


def copies(chunks: DataFrame) -> DataFrame:
    """class_id, chunk_id, length: every chunk of at least LEAST characters with the least id of those with the same content."""
    ids = _texts(chunks).select("chunk_id", F.length("content").alias("length"), F.sha2("content", 256).alias("digest"))
    least = ids.groupBy("digest").agg(F.min("chunk_id").alias("class_id"))
    return ids.join(least, "digest").select("class_id", "chunk_id", "length").distinct()


def shared_between_classes(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """chunk_id_a < chunk_id_b, length_a, length_b, spans_a, spans_b: the pairs of classes with at least LEAST characters in common; a class goes by its least id."""
    texts = _texts(chunks)
    firsts = members.where("class_id = chunk_id").select("chunk_id")
    kept = texts.mapInArrow(_anchor_rows, "anchor bigint, chunk_id bigint").join(firsts, "chunk_id", "left_semi").select("anchor", "chunk_id")
    a, b = kept.withColumnRenamed("chunk_id", "chunk_id_a"), kept.withColumnRenamed("chunk_id", "chunk_id_b")
    pairs = a.join(b, "anchor").where("chunk_id_a < chunk_id_b").select("chunk_id_a", "chunk_id_b").distinct()
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("chunk_id").alias(f"chunk_id_{x}"), F.col("content").alias(f"content_{x}")), f"chunk_id_{x}")
    spans = "array<struct<first:int,last:int>>"
    found = pairs.select("chunk_id_a", "chunk_id_b", "content_a", "content_b").mapInArrow(_verified, f"chunk_id_a bigint, chunk_id_b bigint, length_a int, length_b int, spans_a {spans}, spans_b {spans}")
    return found.dropDuplicates(["chunk_id_a", "chunk_id_b"])


def _whole(length: str) -> Column:
    return F.array(F.struct(F.lit(0).alias("first"), F.col(length).cast("int").alias("last")))


def shared_passages(chunks: DataFrame) -> DataFrame:
    """chunk_id_a < chunk_id_b, length_a, length_b, spans_a, spans_b: the pairs of chunks with at least LEAST characters in common.

    Only different contents are compared; pairs of copies, and those of copies of what was
    compared, follow from the classes.  Spans are of code points, white space counts, and
    neighbouring or overlapping ones are one.  A chunk without id or content, or a shorter one,
    has no pair; a row that is given again with the same id and content counts once, and other
    columns are ignored.
    """
    members = cut(copies(chunks))
    of = {x: members.select(F.col("class_id").alias(f"class_{x}"), F.col("chunk_id").alias(f"chunk_id_{x}"), F.col("length").alias(f"length_{x}")) for x in "ab"}
    between = shared_between_classes(chunks, members).select(F.col("chunk_id_a").alias("class_a"), F.col("chunk_id_b").alias("class_b"), F.col("spans_a").alias("x"), F.col("spans_b").alias("y"))
    rows = between.join(of["a"], "class_a").join(of["b"], "class_b")
    turned = F.col("chunk_id_a") > F.col("chunk_id_b")
    ordered = [F.when(turned, F.col(p)).otherwise(F.col(q)).alias(name) for name, p, q in (("chunk_id_a", "chunk_id_b", "chunk_id_a"), ("chunk_id_b", "chunk_id_a", "chunk_id_b"), ("length_a", "length_b", "length_a"), ("length_b", "length_a", "length_b"), ("spans_a", "y", "x"), ("spans_b", "x", "y"))]
    same = of["a"].join(of["b"], F.col("class_a") == F.col("class_b")).where("chunk_id_a < chunk_id_b")
    return rows.select(*ordered).unionByName(same.select("chunk_id_a", "chunk_id_b", "length_a", "length_b", _whole("length_a").alias("spans_a"), _whole("length_b").alias("spans_b")))


def _covered(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(tuple(x) for x in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def reappearances(chunks: DataFrame) -> DataFrame:
    """chunk_id, spans, partners, share: for each chunk the longest parts found in other chunks, those chunks and the share of its content; a chunk without any has no row."""
    members = cut(copies(chunks))
    pairs = cut(shared_between_classes(chunks, members))
    sides = [pairs.select(F.col(f"chunk_id_{x}").alias("class_id"), F.col(f"chunk_id_{y}").alias("other"), F.col(f"spans_{x}").alias("spans")) for x, y in ("ab", "ba")]
    several = members.groupBy("class_id").agg(F.count("*").alias("n"), F.max("length").alias("length")).where("n > 1")
    links = sides[0].union(sides[1]).unionByName(several.select("class_id", F.col("class_id").alias("other"), _whole("length").alias("spans")))
    covered = F.udf(_covered, "array<struct<first:int,last:int>>", useArrow=True)
    spans = links.groupBy("class_id").agg(F.flatten(F.collect_set("spans")).alias("spans")).withColumn("spans", covered("spans"))
    others = links.select("class_id", "other").join(members.select(F.col("class_id").alias("other"), F.col("chunk_id").alias("partner")), "other")
    partners = others.groupBy("class_id").agg(F.array_sort(F.collect_set("partner")).alias("partners"))
    share = F.aggregate("spans", F.lit(0), lambda n, x: n + x["last"] - x["first"]) / F.col("length")
    of = members.join(spans, "class_id").join(partners, "class_id")
    return of.select("chunk_id", "spans", F.array_remove("partners", F.col("chunk_id")).alias("partners"), share.alias("share"))
