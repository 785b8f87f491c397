"""Files cut into chunks within a size limit, as one narrow map over files."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.errors import ChunkError
from corpusmill.operators import cutting as C
from corpusmill.storage import spread

LIMIT = 2000
_ROW = "file_path string, ext string, position int, first_character_index int, last_character_index int, content string, kind string, message string"


def checked_limit(limit: object) -> int:
    """The limit, if it is a whole number from 1 to 2000."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= LIMIT:
        raise ValueError(f"max_chunk_size must be a whole number from 1 to {LIMIT}")
    return limit


def spans_of(text: str, ext: str, limit: int, overlap: int | None = None, byte_columns: bool = False, split: C.Splitter = C.paragraphs) -> tuple[list[C.Span], list[tuple[str, str]]]:
    """The chunks of one file, and diagnostics as (kind, message); a Python text that doesn't parse has no chunks.

    `split` gives the paragraphs of texts and Python units, Markdown has its own.
    """
    notes: list[tuple[str, str]] = []

    def too_long(size: int) -> None:
        notes.append(("long line", f"a line of {size} characters exceeds {limit} and is cut into windows"))

    def pieces(first: int, last: int, split: C.Splitter = split) -> list[C.Span]:
        return list(C.fragments(text, first, last, limit, overlap, split, too_long))

    if ext == "py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                units = C.definitions(text, byte_columns)
        except (SyntaxError, ValueError, RecursionError) as e:
            return [], [("unparsable", f"{type(e).__name__}: {e}")]
        return [x for unit in units for x in pieces(*unit)], notes
    if ext == "md":
        packed = C.pack(C.sections(text), limit)
        return [x for part in packed for x in ([part] if part[1] - part[0] <= limit else pieces(*part, C.markdown_blocks))], notes
    return pieces(0, len(text)), notes


def cut_files(files: DataFrame, limit: int = LIMIT, overlap: int | None = None, byte_columns: bool = False, split: C.Splitter = C.paragraphs) -> DataFrame:
    """The chunks of .txt, .md and .py files in one row each, and one row with `kind` and `message` for each diagnostic."""
    checked_limit(limit)
    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in _ROW.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, ext, text in zip(*(batch[x].to_pylist() for x in ("file_path", "ext", "content"))):
                spans, notes = spans_of(text, ext, limit, overlap, byte_columns, split)
                out += [(path, ext, i, a, b, text[a:b], None, None) for i, (a, b) in enumerate(spans)]
                out += [(path, ext, None, None, None, None, *x) for x in notes]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)

    return spread(files.where(F.col("content").isNotNull() & F.col("ext").isin("txt", "md", "py")).select("file_path", "ext", "content")).mapInArrow(rows, _ROW)


def chunk_files(files: DataFrame, limit: int = LIMIT, overlap: int | None = None, byte_columns: bool = False, split: C.Splitter = C.paragraphs) -> DataFrame:
    """file_path, ext, position, first_character_index, last_character_index, content of every chunk; the same content under one path counts once."""
    rows = cut_files(files, limit, overlap, byte_columns, split).where("kind is null").drop("kind", "message")
    return rows.dropDuplicates(["file_path", "first_character_index", "last_character_index"])


def diagnostics(files: DataFrame, limit: int = LIMIT) -> DataFrame:
    """file_path, kind, message: files that don't parse, lines that are too long, and each kind of file that is missing."""
    rows = cut_files(files, limit).where("kind is not null").select("file_path", "kind", "message")
    kinds = files.sparkSession.createDataFrame([("txt",), ("md",), ("py",)], "ext string")
    missing = kinds.join(files.select("ext").distinct(), "ext", "left_anti").select(F.lit(None).cast("string").alias("file_path"), F.lit("no files").alias("kind"), F.concat(F.lit("no ."), "ext", F.lit(" file to cut")).alias("message"))
    return rows.unionByName(missing).distinct()


def require_files(files: DataFrame) -> DataFrame:
    """The files, if there is any that can be cut."""
    if files.where(F.col("ext").isin("txt", "md", "py")).isEmpty():
        raise ChunkError("there is no .txt, .md or .py file to cut")
    return files


def spans(files: DataFrame, ext: str, of: str, limit: int = LIMIT) -> DataFrame:
    """file_path, first, last: one kind of span (lines, paragraphs, blocks, sections, definitions or packed lines) of the files of one kind."""
    make = {
        "lines": lambda t: C.line_bounds(t), "paragraphs": lambda t: C.paragraphs(t), "blocks": lambda t: C.markdown_blocks(t), "sections": lambda t: C.sections(t),
        "definitions": lambda t: _parsed(t), "packed lines": lambda t: C.pack(C.line_bounds(t), limit),
    }[of]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, *x) for p, t in zip(batch["file_path"].to_pylist(), batch["content"].to_pylist()) for x in make(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32()))], names=["file_path", "first", "last"])

    return spread(files.where((F.col("ext") == ext) & F.col("content").isNotNull()).select("file_path", "content")).mapInArrow(rows, "file_path string, first int, last int").distinct()


def _parsed(text: str) -> list[C.Span]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return C.definitions(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
