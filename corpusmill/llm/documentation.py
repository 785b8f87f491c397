"""Functions of Python files, paired with their own documentation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.pysource import clean_documentation, functions, is_trivial, parses
from corpusmill.storage import spread


def documented(source: str) -> list[tuple[str, int, int, str]]:
    """qualname, span and cleaned documentation of the functions whose documentation isn't trivial; none if the text isn't Python 3."""
    out = []
    for f in functions(source):
        text = clean_documentation(f.documentation, f.origin)
        if text and not is_trivial(f.qualname.rpartition(".")[2], text):
            out.append((f.qualname, f.first, f.last, text))
    return out if out and parses(source) else []  # what has no case needn't be parsed


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, name) for p, s in zip(batch["file_path"].to_pylist(), batch["content"].to_pylist()) for name in dict.fromkeys(x[0] for x in documented(s))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(2)], names=["file_path", "qualname"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"file_path": pa.string(), "source": pa.string(), "qualname": pa.string(), "first": pa.int32(), "last": pa.int32(), "code": pa.string(), "description": pa.string()}
    for batch in batches:
        rows = []
        for p, s in zip(batch["file_path"].to_pylist(), batch["content"].to_pylist()):
            source = hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            rows += [(p, source, name, a, b, s[a:b], text) for name, a, b, text in documented(s)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _sources(files: DataFrame) -> DataFrame:
    return spread(files.where((F.col("ext") == "py") & F.col("file_path").isNotNull() & F.col("content").isNotNull()).select("file_path", "content"))


def documented_names(files: DataFrame) -> DataFrame:
    """file_path, qualname of every function with documentation of its own, once each.

    Files without a path or content, empty ones, those that don't parse and other kinds of files
    have no row; functions of one name in one file are one row.  Other columns are ignored.
    """
    return _sources(files).mapInArrow(_names, "file_path string, qualname string").distinct()


def code_descriptions(files: DataFrame) -> DataFrame:
    """file_path, qualname, first, last, code, description of every function with documentation of its own.

    Offsets are code points.  Files without a path or content, empty ones and those that don't
    parse have no rows; a path scanned again with the same content counts once, with another one
    on its own.  Other columns are ignored.
    """
    rows = _sources(files).mapInArrow(_pairs, "file_path string, source string, qualname string, first int, last int, code string, description string")
    return rows.dropDuplicates(["file_path", "source", "first", "last"]).drop("source")
