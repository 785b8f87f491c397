"""Python files that nobody on the project wrote by hand, by a random forest.

What a file's header says of itself (its first comments and its docstring) gives labels, and is
taken out before anything is measured.  The forest learns from them how the body of generated
code and of data differs from that of files under the project's own licence line.  Copies of
other projects' files look as if written by hand; for them the notices tell which directories
hold such files.
"""

from __future__ import annotations

import keyword
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import cut, spread

#: Labelled files that the forest learns from, at most; those with the least hash of their path.
TRAINED_ROWS = 20_000
TREES, DEPTH = 60, 6
#: No minified file says so in a header; of each so many hand-written ones, one is minified here for the forest to learn from.
MINIFIED = 8
#: From this probability on a file counts.  The hand-written files it learns from are of every kind, the others not; hence less than a half.
SURE = 0.35
#: A directory is foreign if so large a share of its files say that they are copies, and if that is so much likelier (natural logarithm, above that of the number of directories) than by chance.
FOREIGN_SHARE, FOREIGN_EVIDENCE = 0.2, 7.0

_COMMENTS = re.compile(r"\ufeff?(?:[ \t\f]*(?:#[^\n\r]*)?(?:\r\n|\r|\n))*(?:[ \t\f]*#[^\n\r]*\Z)?")
_DOCSTRING = re.compile(r"""\s*[rRuU]?(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')[ \t]*(?:\#[^\n\r]*)?(?=[\r\n;]|\Z)""", re.X | re.S)
_FILE = r"(?:this|the) (?:file|module|code|source|script|document|stub|package)"
_BY = r"(?:automatically |auto-?|machine-?)?(?:generated|produced|created|written|built|emitted|compiled)(?: automatically| mechanically)?"
# Notices, each at the beginning of a header's line or sentence.
_MACHINE = re.compile(
    rf"(?:{_FILE} (?:is|was|has been) {_BY}(?: by| from| with| using|[.,;:]|$)|{_FILE} is auto-?generated|(?:auto-?|automatically |machine-?)generated\b(?! \w+ (?:is|are)\b)"
    rf"|(?:(?:python |protocol buffer |source )?(?:code|file|source|stubs?|bindings?|parser|tables?|output)s? )?generated (?:automatically )?(?:by|from|with|using) |(?:produced|created|generated) automatically\b|@(?:partially-)?generated\b"
    rf"|.*\bdo not (?:edit|modify|change)(?: (?:this|by hand|manually|directly)|[.!]|$)|(?:any |your |manual |local )?(?:changes|edits|modifications) (?:to this file |made here |here )?(?:will|are|may) be (?:lost|overwritten))",
    re.I,
)
_COPIED = re.compile(
    r"(?:(?:this is an? |an? )?(?:vendored|bundled|verbatim|unmodified|unchanged) (?:copy|version|from)\b|vendored\b|(?:this (?:file|module) (?:is|was) )?(?:copied|taken|imported|vendored) (?:unchanged|verbatim|unmodified|as is|as-is|without changes|in full) (?:from|out of)\b"
    r"|(?:this (?:file|module) (?:is|was) )?(?:copied|vendored) from\b|.*\b(?:imported|copied|included|taken) (?:as is|as-is|verbatim|unchanged|unmodified)\b|.*\bsend (?:fixes|patches|changes|bugs) upstream\b|distributed with .{1,60} under its own licen[cs]e|this file is part of the .{1,60} (?:project|distribution|library)\b)",
    re.I,
)
_DATA = re.compile(r"(?:(?:lookup|static|raw|embedded|token|character|unicode|binary|packed|precomputed|constant)\s+){1,2}(?:data|tables?|blobs?|weights|arrays?|constants)\.?\s*$", re.I)
_OWN = re.compile(r"SPDX-License-Identifier:", re.I)
_SENTENCE = re.compile(r"[\r\n]+|(?<=[.;!])\s+|,\s+(?=imported)")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_WORDS = re.compile(r"\w+")
_COMMENT = re.compile(r"(?m)(?:^|[ \t])#[^\n\r]*")
_FOREIGN = r"(?i)^[_.]?(vendor(ed)?|(third|3rd)[-_]?party|externs?|externals?|deps|bundled|node_modules|(site|dist)-packages|(\w+_)?copies)$"
FEATURES = (
    "compression", "token_entropy", "identifier_length", "short_identifiers", "distinct_identifiers", "comments", "digits", "letters", "white_space", "punctuation", "line_length", "longest_line", "line_shapes", "definitions", "strings", "semicolons", "escapes", "longest_token",
)


def header(source: str) -> tuple[str, str]:
    """The first comments and the docstring, and the rest."""
    at = 0
    for _ in range(2):
        at = _COMMENTS.match(source, at).end()
        m = _DOCSTRING.match(source, at)
        if not m:
            break
        at = m.end()
    return source[:at], source[at:]


def notice(head: str) -> str | None:
    """What a header says of its file: machine, copied, data or own."""
    lines = [x.strip().strip("#\"'*/-=~ \t").strip() for x in _SENTENCE.split(re.sub(r"\\\r?\n", "", head))]
    for kind, pattern in (("machine", _MACHINE), ("copied", _COPIED), ("data", _DATA)):
        if any(pattern.match(x.removeprefix("upstream: ")) for x in lines):
            return kind
    return "own" if any(_OWN.match(x) for x in lines) else None


def features(body: str) -> list[float]:
    """The values of FEATURES; shares are of characters, unless the name says otherwise."""
    n = len(body)
    tokens = Counter(_TOKEN.findall(body))
    total = sum(tokens.values()) or 1
    names = [(x, k) for x, k in tokens.items() if x[0] == "_" or x[0].isalpha()]
    named = sum(k for _, k in names) or 1
    lines = body.split("\n")
    full = [x for x in lines if x.strip()] or [""]
    data = body.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(data, dtype=np.uint8)
    kinds = np.bincount(_KINDS[codes], minlength=5) / max(len(data), 1)
    shapes = Counter(_WORDS.sub("w", x) for x in full)
    return [
        len(zlib.compress(data, 1)) / max(len(data), 1),
        -sum(k / total * math.log2(k / total) for k in tokens.values()),
        sum(len(x) * k for x, k in names) / named,
        sum(k for x, k in names if len(x) <= 2) / named,
        len(names) / named,
        sum(len(x) for x in _COMMENT.findall(body)) / n,
        *kinds[:4].tolist(),
        sum(map(len, full)) / len(full),
        math.log1p(max(map(len, lines))),
        len(shapes) / len(full),
        sum(k for x, k in tokens.items() if x in ("def", "class", "lambda")) / len(full),
        (tokens['"'] + tokens["'"]) / total,
        tokens[";"] / total,
        tokens["\\"] / total,
        math.log1p(max(map(len, tokens), default=0)),
    ]


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_KINDS = np.full(256, 4)  # 0 digits, 1 letters, 2 white space, 3 punctuation
for _c in map(chr, range(128)):
    _KINDS[ord(_c)] = 0 if _c.isdigit() else 1 if _c.isalpha() else 2 if _c.isspace() else 3


def minified(body: str) -> str:
    """The body as a minifier would leave it: comments and indentation gone, names short, statements joined."""
    short: dict[str, str] = {}

    def name(m: re.Match) -> str:
        word = m[0]
        if keyword.iskeyword(word) or word.startswith("__"):
            return word
        if word not in short:
            i = len(short)
            short[word] = _LETTERS[i % 26] + (_LETTERS[i // 26 % 26] if i >= 26 else "")
        return short[word]

    lines = [re.sub(r"[^\W\d]\w*", name, re.sub(r"[ \t]*([^\w \t])[ \t]*", r"\1", x.strip())) for x in _COMMENT.sub("", body).split("\n")]
    out = ""
    for x in filter(None, lines):
        out += x if not out or out[-1] in "\n,:([{" else ("\n" if x.startswith(("def ", "class ", "for ", "if ", "@", "async ")) else ";") + x
    return out + "\n"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, source in zip(batch["file_path"].to_pylist(), batch["content"].to_pylist()):
            head, body = header(source)
            says, key = notice(head), xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass"))
            out.append({"file_path": path, "source": key - (1 << 63), "notice": says, "features": features(body) if body.strip() else None, "dirs": sorted(set(path.split("/")[:-1]) - {"", "."})})
            if says == "own" and key % MINIFIED == 0 and body.strip():
                out.append({"file_path": path, "source": key - (1 << 63), "notice": "minified", "features": features(minified(body)), "dirs": []})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file_path", pa.string()), ("source", pa.int64()), ("notice", pa.string()), ("features", pa.list_(pa.float64())), ("dirs", pa.list_(pa.string()))]))


def described(files: DataFrame) -> DataFrame:
    """file_path, source, notice, features, dirs of every .py file that isn't blank; a path scanned again with the same content once.

    For every MINIFIEDth file with the project's own licence line there is a second row, with the
    notice `minified`: what a minifier would have made of it.
    """
    sources = files.where((F.col("ext") == "py") & F.col("file_path").isNotNull() & F.col("content").isNotNull()).select("file_path", "content").where(F.col("content").rlike(r"\S"))
    rows = spread(sources).mapInArrow(_rows, "file_path string, source bigint, notice string, features array<double>, dirs array<string>")
    return rows.dropDuplicates(["file_path", "source", "notice"])


def foreign_directories(rows: DataFrame) -> DataFrame:
    """dir: the directories that hold other projects' files, by their name or by what the files below them say."""
    copied = F.col("notice").eqNullSafe("copied").cast("int")
    of = cut(rows.select(copied.alias("own"), F.explode("dirs").alias("dir")).groupBy("dir").agg(F.count("*").alias("n"), F.sum("own").alias("k")))
    files, all_copied = rows.agg(F.count("*"), F.sum(copied)).first()
    part = min(max((all_copied or 0) / max(files, 1), 1e-9), 1 - 1e-9)
    n, k = F.col("n"), F.col("k")
    share = F.least(k / n, F.lit(1 - 1e-9))
    evidence = k * F.log(share / part) + (n - k) * F.log((1 - share) / (1 - part))
    least = FOREIGN_EVIDENCE + math.log(max(of.count(), 1))
    return of.where(F.col("dir").rlike(_FOREIGN) | ((k > 0) & (share > part) & (share >= FOREIGN_SHARE) & (evidence >= least))).select("dir")


def _made(rows: DataFrame) -> DataFrame:
    """The rows with `made`, the probability that the forest gives them; 0 where it can't learn or nothing can be measured."""
    label = F.when(F.col("notice").isin("machine", "data", "minified"), 1.0).when(F.col("notice") == "own", 0.0)
    labelled = rows.withColumn("label", label).where("label is not null and features is not null")
    sample = cut(labelled.orderBy(F.xxhash64("file_path"), "file_path", "source").limit(TRAINED_ROWS).select("label", array_to_vector("features").alias("values")))
    counts = {x.label: x["count"] for x in sample.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        return rows.withColumn("made", F.lit(0.0))
    total = sum(counts.values())
    weighted = sample.withColumn("weight", F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0])))
    forest = RandomForestClassifier(featuresCol="values", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=2, seed=11).fit(weighted)
    given = rows.withColumn("values", array_to_vector(F.coalesce("features", F.array(*[F.lit(0.0)] * len(FEATURES)))))
    made = F.when(F.col("features").isNull(), 0.0).otherwise(vector_to_array("probability")[1])
    return forest.transform(given).withColumn("made", made).drop("values", "rawPrediction", "probability", "prediction")


def scored(files: DataFrame) -> DataFrame:
    """file_path, source, notice, made, foreign: each .py file's own notice, how likely a machine made it, and whether it lies in a directory of another project's files.

    A file whose body is blank has the probability 0 of being made.  Files without a path or
    content, blank ones and other kinds of files have no row; other columns are ignored.
    """
    every = cut(described(files))
    real = F.coalesce(F.col("notice") != "minified", F.lit(True))
    rows = every.where(real)
    dirs = foreign_directories(rows)
    below = rows.select("file_path", F.explode("dirs").alias("dir")).join(dirs, "dir", "left_semi").select("file_path", F.lit(True).alias("foreign")).distinct()
    return _made(every).where(real).join(below, "file_path", "left").select("file_path", "source", "notice", "made", F.coalesce("foreign", F.lit(False)).alias("foreign"))


def not_handwritten(files: DataFrame) -> DataFrame:
    """file_path of the .py files that the forest takes for no hand-written ones, that lie among other projects' files, or that say so themselves."""
    own_words = F.coalesce(F.col("notice").isin("machine", "copied", "data"), F.lit(False))
    return scored(files).where(own_words | (F.col("made") >= SURE) | F.col("foreign")).select("file_path").distinct()
