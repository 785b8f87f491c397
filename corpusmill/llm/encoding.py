"""Texts that were decoded with a wrong character encoding: what was done to them is learned from near-twins.

1. Running text (what is neither fenced nor between backticks) is cut at its ASCII words; what
   lies between two of them, where it isn't ASCII, is a passage.  Its key is those words: the
   text around it, stripped of all other characters.
2. Passages with equal keys are near-twins, of which the more frequent one is taken as clean.
   Where their other characters agree, runs of non-ASCII characters are aligned one by one, and
   each chain of encodings that turns the clean run into the other one gets a vote.  Of the
   chains of two runs, the one with most votes is a learned mapping.  All near-twins and all of
   their runs vote, but for two that a still more frequent run was turned into: neither of
   them is clean.
3. The mappings are undone wherever that makes the text likelier, by the counts of adjacent
   characters in all passages.  A replacement character in running text is a decoding
   that can't be undone.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.storage import cut, spread

#: Public encodings that are tried; the first ones have a character a byte.
SINGLE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac-roman", "mac-cyrillic", "cp437", "cp850", "cp852", "cp1253", "cp1254", "cp1257", "iso8859-15")
MULTI = ("gbk", "cp932", "big5", "euc_kr", "euc_jp")
#: At a place with at most so many runs, each two are compared; at others, those that share bytes, which gives the same votes.
PAIRED = 32
#: Buckets of the counts of adjacent characters in each of two tables, of which the smaller count holds; they have this size whatever the corpus.
BUCKETS = 1 << 20
#: By how much (natural logarithm) an undone run must be likelier; and all of a document's together, in logarithms of the number of passages, as chance finds more among more.
RUN_GAIN, TEXT_GAIN = 4.0, 1.75
#: Of chains from one byte encoding to another, so many different runs must tell.
VOTES = 2

_WORD = re.compile(r"([A-Za-z0-9_]{3,})")
_RUN = re.compile(r"[^\x00-\x7f]+")
_FENCE = re.compile(r"(?m)^[ \t]{0,3}(?:>[ \t]?)*(`{3,}|~{3,})")
_TICKS = re.compile(r"`+|\n[ \t]*\n")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_FOLDED = {**{c: "0" for c in "0123456789"}, "\t": " ", "\r": " "}
_ALL = (1 << 64) - 1
_LOST = "�"
Chain = tuple[str, ...]  # from, to, from, to: bytes of the first were read as the second


def prose(text: str) -> list[tuple[int, int]]:
    """Spans of running text: outside fences and outside backticks, in order."""
    if "`" not in text and "~~~" not in text:
        return [(0, len(text))]
    blocks, at, open_, begun = [], 0, "", 0
    for m in _FENCE.finditer(text):
        mark = m[1]
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        if not open_:
            if mark[0] == "`" and "`" in text[m.end() : end]:
                continue
            blocks.append((at, m.start()))
            open_, begun = mark, m.start()
        elif mark[0] == open_[0] and len(mark) >= len(open_) and not text[m.end() : end].strip():
            open_, at = "", end
    if not open_:
        blocks.append((at, len(text)))
    spans = []
    for first, last in blocks:
        marks = [(m.start(), m.end(), m.end() - m.start() if m[0][0] == "`" else 0) for m in _TICKS.finditer(text, first, last)]
        later: dict[int, list[int]] = {}
        for i in range(len(marks) - 1, -1, -1):
            later.setdefault(marks[i][2], []).append(i)
        i = 0
        while i < len(marks):
            size = marks[i][2]
            if size:
                for w in (size, 0):
                    while w in later and later[w] and later[w][-1] <= i:
                        later[w].pop()
                close, blank = (later.get(w) or [len(marks)] for w in (size, 0))
                if close[-1] < min(blank[-1], len(marks)):
                    spans.append((first, marks[i][0]))
                    i = close[-1]
                    first = marks[i][1]
            i += 1
        spans.append((first, last))
    return spans


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """Offset and text of each piece of a line of running text that isn't ASCII."""
    for first, last in prose(text):
        part = text[first:last]
        if part.isascii():
            continue
        at = first
        for line in part.split("\n"):
            if not line.isascii():
                yield at, line
            at += len(line) + 1


def passages(text: str) -> Iterator[tuple[str, str]]:
    """Key and passage; the passage has the kind of the character before and after it at its ends."""
    for _, line in _lines(text):
        parts = _WORD.split(line)
        for i in range(0, len(parts), 2):
            gap = parts[i]
            if gap and not gap.isascii():
                left = parts[i - 1] if i else ""
                right = parts[i + 1] if i + 1 < len(parts) else ""
                yield f"{left}\0{right}" if left or right else "", f"{left[-1:] or '^'}{gap}{right[:1] or '$'}"


class _Codec:
    """One encoding; bytes that it leaves undefined are control characters, as browsers read them."""

    def __init__(self, name: str) -> None:
        self.name, self.single = name, name in SINGLE
        if self.single:
            chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(128, 256)]
            self.out = {b: c for b, c in zip(range(128, 256), chars)}
            self.back = {ord(c): b for b, c in self.out.items()}
            self.table = "".join(map(chr, range(128))) + "".join(chars)
            self.map = codecs.charmap_build(self.table)

    def encode(self, text: str) -> bytes:
        return codecs.charmap_encode(text, "strict", self.map)[0] if self.single else text.encode(self.name)

    def decode(self, data: bytes) -> str:
        return codecs.charmap_decode(data, "strict", self.table)[0] if self.single else data.decode(self.name)


CODECS = {x: _Codec(x) for x in (*SINGLE, *MULTI, "utf-8")}
CHAINS: tuple[Chain, ...] = (
    *((a, b) for a in ("utf-8", *SINGLE, *MULTI) for b in (*SINGLE, *MULTI) if a != b),
    *(("utf-8", a, "utf-8", b) for a in SINGLE for b in SINGLE),
)


def garble(text: str, chain: Chain) -> str | None:
    try:
        for a, b in zip(chain[::2], chain[1::2]):
            text = CODECS[b].decode(CODECS[a].encode(text))
    except ValueError:
        return None
    return text


def undo(text: str, chain: Chain) -> str | None:
    """The text before the chain; where only parts of it went through UTF-8, those."""
    try:
        for i in range(len(chain) - 2, -1, -2):
            data = CODECS[chain[i + 1]].encode(text)
            if chain[i] == "utf-8" and CODECS[chain[i + 1]].single:
                kept = CODECS[chain[i + 1]]
                s = data.decode("latin-1")
                try:
                    text = data.decode()
                except UnicodeDecodeError:
                    out, at = [], 0
                    for m in _UTF8.finditer(s):
                        out += [kept.decode(s[at : m.start()].encode("latin-1")), m[0].encode("latin-1").decode("utf-8", "replace")]
                        at = m.end()
                    if not out:
                        return None
                    text = "".join(out) + kept.decode(s[at:].encode("latin-1"))
            else:
                text = CODECS[chain[i]].decode(data)
    except ValueError:
        return None
    return text


class Votes:
    """The chains that turn a clean run into another one, by the bytes that both stand for."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], tuple[Chain, ...]] = {}
        self.bytes: dict[str, dict[bytes, list[Chain]]] = {}
        self.room = [2_000_000, 200_000]  # for the characters of either

    def written(self, clean: str) -> dict[bytes, list[Chain]]:
        """The bytes that a chain reads last, each with the chains up to there."""
        found = self.bytes.get(clean)
        if found is None:
            found = {}
            for name, codec in CODECS.items():
                try:
                    found.setdefault(codec.encode(clean), []).append((name,))
                except ValueError:
                    pass
            data = clean.encode("utf-8", "replace")
            for a in SINGLE:
                found.setdefault(CODECS[a].decode(data).encode(), []).append(("utf-8", a, "utf-8"))
            self.room[1] -= len(clean)
            if self.room[1] < 0:
                self.bytes.clear()
                self.room[1] = 200_000
            self.bytes[clean] = found
        return found

    @staticmethod
    def read(other: str) -> Iterator[tuple[str, bytes]]:
        """The single-byte encodings that can have given a run, and the bytes that they read."""
        for b in SINGLE:
            try:
                yield b, CODECS[b].encode(other)
            except ValueError:
                pass

    def of(self, clean: str, other: str) -> tuple[Chain, ...]:
        found = self.known.get((clean, other))
        if found is None:
            written = self.written(clean)
            chains = [(*c, b) for b, data in self.read(other) for c in written.get(data, ()) if c != (b,)]
            for data, begun in written.items():
                if any(len(c) == 1 for c in begun):
                    chains += [(*c, b) for b in MULTI if _decoded(data, b) == other for c in begun if len(c) == 1 and c != (b,)]
            self.room[0] -= len(clean) + len(other)
            if self.room[0] < 0:
                self.known.clear()
                self.room[0] = 2_000_000
            found = self.known[clean, other] = tuple(chains)
        return found

    def made(self, clean: str) -> set[bytes]:
        """One of these is among the sources() of every run that a chain makes of this one."""
        texts = {_decoded(data, b) for data, begun in self.written(clean).items() if any(len(c) == 1 for c in begun) for b in MULTI}
        return {b"b" + x for x in self.written(clean)} | {b"t" + x.encode() for x in texts if x}

    def sources(self, other: str) -> set[bytes]:
        return {b"b" + data for _, data in self.read(other)} | {b"t" + other.encode("utf-8", "replace")}


def _decoded(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except ValueError:
        return None


def _buckets(texts: list[str]) -> np.ndarray:
    """The bucket in either table (a column each) of each two adjacent characters of which one isn't ASCII."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    codes[(codes == 9) | (codes == 13)] = 32
    if len(codes) < 2:
        return np.zeros((0, 2), dtype=np.int64)
    a, b = codes[:-1], codes[1:]
    kept = ((a > 127) | (b > 127)) & (a != 0) & (b != 0)
    h = (a[kept] << np.uint64(21) | b[kept]) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    mask = np.uint64(BUCKETS - 1)  # _pair() does the same
    return np.stack([h & mask, (h >> np.uint64(24) & mask) + np.uint64(BUCKETS)], axis=1).astype(np.int64)


def _pair(x: str, y: str) -> tuple[int, int] | None:
    """Both buckets of two characters."""
    a, b = ord(_FOLDED.get(x, x)), ord(_FOLDED.get(y, y))
    if (a < 128 and b < 128) or not a or not b:
        return None
    h = (a << 21 | b) * 0x9E3779B97F4A7C15 & _ALL
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & _ALL
    h ^= h >> 29
    return h & BUCKETS - 1, (h >> 24 & BUCKETS - 1) + BUCKETS


class Likelihood:
    """How unlikely a run is, by the share of passages that have its adjacent characters."""

    def __init__(self, counts: np.ndarray, passages: int) -> None:
        self.least = TEXT_GAIN * float(np.log(max(passages, 2)))
        self.costs = np.maximum(np.log(max(passages, 1)) - np.log(counts + 0.5), 0).astype(np.float32)
        self.known: dict[str, float] = {}

    def cost(self, text: str) -> float:
        total, known = 0.0, self.known
        for x, y in zip(text, text[1:]):
            pair = x + y
            got = known.get(pair)
            if got is None:
                if len(known) > 1_000_000:
                    known.clear()
                at = _pair(x, y)
                got = known[pair] = max(float(self.costs[i]) for i in at) if at else 0.0
            total += got
        return total


Found = tuple[float, np.ndarray, list[str | None], list[tuple[Chain, float, str]]]


class Restorer:
    """Finds what a learned chain can undo in a text.

    What went through UTF-8 is undone run by run.  Other chains have to make a whole line likelier.
    """

    def __init__(self, chains: list[Chain], likelihood: Likelihood) -> None:
        self.likelihood = likelihood
        self.strict = [c for c in chains if c[0] == "utf-8"]
        self.lines = [c for c in chains if c[0] in ("gbk", "cp932", "big5")]  # their second bytes may be ASCII
        self.bytes = [c for c in chains if c not in self.strict and c not in self.lines]
        self.known: dict[str, Found] = {}

    def gains(self, run: str, chains: list[Chain]) -> Iterator[tuple[float, str | None]]:
        """Gain and undone text, for each chain, of a run between its neighbours."""
        cost, inner = None, run[1:-1]
        for chain in chains:
            back = undo(inner, chain)
            if back is None or back == inner or back.isspace() or _LOST in back:
                yield 0.0 if back == inner else -RUN_GAIN, None
            else:
                cost = self.likelihood.cost(run) if cost is None else cost
                yield cost - self.likelihood.cost(run[0] + back + run[-1]), back

    def run(self, run: str) -> Found:
        """The most that a chain of `bytes` gains, what each gains and gives; and what those of `strict` give."""
        found = self.known.get(run)
        if found is None:
            strict = [c for c in self.strict if c[1] in MULTI] if len(run) == 3 else self.strict  # several bytes are several characters
            sure = [(c, gain, back) for c, (gain, back) in zip(strict, self.gains(run, strict)) if back is not None and gain > 0]
            each = list(self.gains(run, self.bytes))
            found = (max((g for g, _ in each), default=0.0), np.array([g for g, _ in each], dtype=np.float64), [b for _, b in each], sure)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[run] = found
        return found

    def restore(self, text: str) -> tuple[Chain | None, str | None] | None:
        """The chain and the restored text; no chain or text if it can't be restored; None if nothing is garbled."""
        lost = False
        total: Counter[Chain] = Counter()
        edits: dict[Chain, list[tuple[int, int, str]]] = {}
        for at, line in _lines(text):
            lost = lost or _LOST in line
            most, seen = 0.0, []
            for m in _RUN.finditer(line):
                first, last = m.span()
                before, after = line[first - 1] if first else "^", line[last] if last < len(line) else "$"
                found = self.run(f"{_FOLDED.get(before, before)}{m[0]}{_FOLDED.get(after, after)}")
                most += found[0]
                seen.append((at + first, at + last, found))
                for chain, gain, back in found[3]:
                    if gain >= RUN_GAIN:
                        total[chain] += gain
                    edits.setdefault(chain, []).append((at + first, at + last, back))
            if most >= RUN_GAIN and self.bytes:
                sums = np.sum([x[2][1] for x in seen], axis=0)
                for i in np.flatnonzero(sums >= RUN_GAIN):
                    chain = self.bytes[i]
                    total[chain] += float(sums[i])
                    edits.setdefault(chain, []).extend((p, q, f[2][i]) for p, q, f in seen if f[2][i] is not None)
            if self.lines:
                for chain, (gain, back) in zip(self.lines, self.gains(f"^{line}$", self.lines)):
                    if gain >= RUN_GAIN and back is not None:
                        total[chain] += gain
                        edits.setdefault(chain, []).append((at, at + len(line), back))
        best = max(total, key=lambda c: (total[c], -len(c), c), default=None)
        if best is None or total[best] < self.likelihood.least:
            return (None, None) if lost else None
        if lost:
            return best, None
        out, end = [], 0
        for first, last, back in edits[best]:
            out += [text[end:first], back]
            end = last
        return best, "".join(out) + text[end:]


def _hash(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: Counter[tuple[int, str]] = Counter()
        for text in batch["text"].to_pylist():
            for key, gap in set(passages(text)):
                rows[_hash(key) if key else 0, gap] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([g for _, g in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["key", "passage", "n"])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(2 * BUCKETS, dtype=np.int64)
    for batch in batches:
        weights = batch["n"].to_numpy()
        for n in np.unique(weights):  # most passages occur once
            at, times = np.unique(_buckets(batch["passage"].filter(pa.array(weights == n)).to_pylist()), return_counts=True)
            counts[at] += times * n
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of passages; a place is a key, the other characters of a passage and a run's number."""
    for batch in batches:
        rows: list[tuple[int, str, int]] = []
        for key, passage, n in zip(*(batch[c].to_pylist() for c in ("key", "passage", "n"))):
            if _LOST not in passage:
                shape = _RUN.sub("\x80", passage[1:-1])
                rows += [(_hash(f"{key} {i} {shape}"), run, n) for i, run in enumerate(_RUN.findall(passage[1:-1]))]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.int64())], names=["place", "run", "n"])


def _link_rows(links: Callable[[Votes, str], set[bytes]], names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes = Votes()
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):  # a run has up to some 150 links
            rows = [(_hash(place.to_bytes(8, signed=True) + x), id_, n) for place, id_, run, n in zip(*(part[c].to_pylist() for c in ("place", "id", "run", "n"))) for x in links(votes, run)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], names=names)


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes = Votes()
    for batch in batches:
        chains = [[">".join(c) for c in votes.of(*x)] for x in zip(batch["clean"].to_pylist(), batch["other"].to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chains, pa.list_(pa.string()))], names=[*batch.schema.names, "chains"]).filter(pa.array([bool(x) for x in chains], pa.bool_()))


def _votes(passages: DataFrame) -> DataFrame:
    """clean, other, chain: for all aligned runs of all near-twins, each chain that turns the clean one into the other."""
    runs = passages.where("key != 0").select("key", "passage", "n").mapInArrow(_run_rows, "place bigint, run string, n bigint")
    runs = cut(runs.groupBy("place", "run").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    runs = cut(runs.join(runs.groupBy("place").agg(F.count("*").alias("size")).where("size > 1"), "place"))
    few, many = runs.where(F.col("size") <= PAIRED), runs.where(F.col("size") > PAIRED).withColumn("id", F.xxhash64("place", "run"))
    pairs = few.select("place", F.col("run").alias("clean"), "most").join(few.select("place", F.col("run").alias("other"), "least"), "place")
    pairs = pairs.where("clean != other and least <= most").select("place", "clean", "other", "most")
    made = many.select("place", "id", "run", F.col("most").alias("n")).mapInArrow(partial(_link_rows, Votes.made, ["link", "clean_id", "most"]), "link bigint, clean_id bigint, most bigint")
    sources = many.select("place", "id", "run", F.col("least").alias("n")).mapInArrow(partial(_link_rows, Votes.sources, ["link", "other_id", "least"]), "link bigint, other_id bigint, least bigint")
    linked = made.join(sources, "link").where("clean_id != other_id and least <= most").select("clean_id", "other_id").distinct()
    linked = linked.join(many.select("place", F.col("id").alias("clean_id"), F.col("run").alias("clean"), "most"), "clean_id")
    linked = linked.join(many.select(F.col("id").alias("other_id"), F.col("run").alias("other")), "other_id")
    pairs = pairs.union(linked.select("place", "clean", "other", "most"))
    pairs = cut(pairs.mapInArrow(_chain_rows, "place bigint, clean string, other string, most bigint, chains array<string>"))
    first = pairs.select("place", F.col("clean").alias("first"), F.col("other").alias("clean"), F.col("most").alias("first_most"))
    both = first.join(pairs, ["place", "clean"]).where("first_most > most").select("place", "first", "clean", "other")
    both = both.join(pairs.select("place", F.col("clean").alias("first"), "other"), ["place", "first", "other"], "left_semi")
    return pairs.join(both, ["place", "clean", "other"], "left_anti").select("clean", "other", F.explode("chains").alias("chain")).distinct()


def _texts(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows.where("doc_id is not null and text is not null and length(text) < octet_length(text)"))


def _restorer(documents: DataFrame) -> Restorer:
    found = _texts(documents).select("text").mapInArrow(_passage_rows, "key bigint, passage string, n bigint")
    found = cut(found.groupBy("key", "passage").agg(F.sum("n").alias("n")))
    counts = np.zeros(2 * BUCKETS, dtype=np.int64)
    table = found.select("passage", "n").mapInArrow(_count_rows, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # two tables of BUCKETS rows at most
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    votes = cut(_votes(found))
    support = F.broadcast(votes.groupBy("chain").count())  # CHAINS bounds its rows
    first = F.row_number().over(Window.partitionBy("clean", "other").orderBy(F.desc("count"), F.length("chain"), "chain"))
    won = votes.join(support, "chain").withColumn("place", first).where("place = 1").select("chain", "count").distinct().collect()
    chains = sorted(tuple(chain.split(">")) for chain, n in won if n >= VOTES or chain.startswith("utf-8>"))
    return Restorer(chains, Likelihood(counts, found.agg(F.sum("n")).first()[0] or 0))


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, chain, restored: each document with running text that was decoded wrongly.

    `chain` names the encodings, from>to, and `restored` is the text before; both are null where
    no learned mapping undoes what a replacement character shows, `restored` where part is lost.
    Null and ASCII texts, and quotations as code, aren't garbled.  Repeated rows give repeated
    rows; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_restorer(documents))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = shared.value
        for batch in batches:
            out = [(i, *x) for i, x in zip(batch["doc_id"].to_pylist(), map(restorer.restore, batch["text"].to_pylist())) if x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([">".join(x[1]) if x[1] else None for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())],
                names=["doc_id", "chain", "restored"],
            )

    return _texts(documents).mapInArrow(rows, "doc_id bigint, chain string, restored string")
