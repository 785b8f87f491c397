"""Spans of one text: lines, paragraphs, Markdown blocks and sections, Python definitions."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, pairwise

Span = tuple[int, int]
Splitter = Callable[[str, int, int], Iterable[Span]]

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADER = re.compile(r" {0,3}#{1,6}(?:\s|\Z)")
_LINE_END = re.compile(r"\r\n|\r|\n")


def line_bounds(text: str, start: int = 0, end: int | None = None) -> Iterator[Span]:
    r"""The lines of text[start:end], without \r and \n at their ends."""
    at = start
    for piece in text[start:end].splitlines(keepends=True):
        yield at, at + len(piece.rstrip("\r\n"))
        at += len(piece)


def paragraphs(text: str, start: int = 0, end: int | None = None) -> Iterator[Span]:
    """Each longest run of lines that aren't blank."""
    for written, run in groupby(line_bounds(text, start, end), key=lambda x: bool(text[x[0] : x[1]].strip())):
        if written:
            held = list(run)
            yield held[0][0], held[-1][1]


def pack(spans: Iterable[Span], limit: int) -> list[Span]:
    """Neighbours joined, with what lies between them, as long as they keep the limit; a longer span stays as it is."""
    out: list[Span] = []
    for first, last in spans:
        if out and last - out[-1][0] <= limit:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def windows(first: int, last: int, limit: int, overlap: int) -> Iterator[Span]:
    """Windows of at most `limit` over [first, last), each `overlap` into the one before."""
    step = max(limit - overlap, 1)
    for at in range(first, max(last - limit, first) + step, step) if last > first else ():
        yield at, min(at + limit, last)
        if at + limit >= last:
            return


def fragments(text: str, start: int, end: int, limit: int, overlap: int | None = None, split: Splitter = paragraphs, too_long: Callable[[int], None] | None = None) -> Iterator[Span]:
    """Spans of at most `limit`: packed paragraphs; of a longer one packed lines; of a longer line windows.

    `too_long` is told the length of each line that takes windows.  Empty spans are left out.
    """
    overlap = int(limit * 0.1) if overlap is None else overlap
    for block in pack(split(text, start, end), limit):
        for first, last in [block] if block[1] - block[0] <= limit else pack(line_bounds(text, *block), limit):
            if last - first > limit:
                if too_long:
                    too_long(last - first)
                yield from windows(first, last, limit, overlap)
            elif last > first:
                yield first, last


def fence_mark(line: str) -> tuple[str, int] | None:
    """Character and length of the mark that opens a fenced block."""
    m = _FENCE.match(line)
    return (m[1][0], len(m[1])) if m else None


def ends_fence(line: str, mark: tuple[str, int]) -> bool:
    """Whether the line closes the block that the mark opened: the same character, as often, and nothing more."""
    m = _FENCE.match(line)
    return bool(m) and m[1][0] == mark[0] and len(m[1]) >= mark[1] and not line[m.end() :].strip()


def marked_lines(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, str]]:
    """The lines with their kind: open, code and close of a fenced block; header, blank and text outside."""
    mark = None
    for first, last in line_bounds(text, start, end):
        line = text[first:last]
        if mark:
            kind = "close" if ends_fence(line, mark) else "code"
            mark = None if kind == "close" else mark
        elif mark := fence_mark(line):
            kind = "open"
        else:
            kind = "header" if _HEADER.match(line) else "text" if line.strip() else "blank"
        yield first, last, kind


def markdown_blocks(text: str, start: int = 0, end: int | None = None) -> Iterator[Span]:
    """Paragraphs, of which a fenced block is one of its own, whatever it holds."""
    held: Span | None = None
    for first, last, kind in marked_lines(text, start, end):
        if held and kind in ("open", "blank"):
            yield held
            held = None
        if kind != "blank":
            held = (held[0] if held else first, last)
        if kind == "close":
            yield held
            held = None
    if held:
        yield held


def header_offsets(text: str, start: int = 0, end: int | None = None) -> list[int]:
    """Where header lines begin, outside fenced blocks."""
    return [first for first, _, kind in marked_lines(text, start, end) if kind == "header"]


def sections(text: str, start: int = 0, end: int | None = None) -> list[Span]:
    """From each header, or the start, to the next header or the end; empty ones are left out."""
    end = len(text) if end is None else end
    cuts = sorted({start, *header_offsets(text, start, end)})
    return [x for x in pairwise([*cuts, end]) if x[1] > x[0]]


class _Places:
    """Offsets of a syntax tree's lines and columns, which count bytes."""

    def __init__(self, text: str, byte_columns: bool) -> None:
        self.text, self.byte_columns = text, byte_columns
        self.starts = [0, *(m.end() for m in _LINE_END.finditer(text))]

    def at(self, line: int, column: int) -> int:
        start = self.starts[line - 1]
        if not self.byte_columns:
            stop = self.starts[line] if line < len(self.starts) else len(self.text)
            row = self.text[start:stop]
            if not row.isascii():
                column = len(row.encode("utf-8", "surrogatepass")[:column].decode("utf-8", "ignore"))
        return start + column

    def begin(self, node: ast.stmt) -> int:
        """A definition begins at the sign of its first decorator."""
        marks = node.decorator_list
        return self.text.rindex("@", 0, self.at(marks[0].lineno, marks[0].col_offset) + 1) if marks else self.at(node.lineno, node.col_offset)

    def finish(self, node: ast.stmt) -> int:
        return self.at(node.end_lineno, node.end_col_offset)


def definitions(text: str, byte_columns: bool = False) -> list[Span]:
    """Units of a Python text: each function or method; between them, and around, what is left.

    Classes are entered at any depth, functions and other statements aren't.  With
    `byte_columns`, columns are added as bytes, which overshoots where a definition's first or
    last line isn't ASCII.  Raises SyntaxError or ValueError if the text doesn't parse.
    """
    places = _Places(text, byte_columns)

    def inside(body: list[ast.stmt], at: int, end: int) -> Iterator[Span]:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first, last = places.begin(node), places.finish(node)
                if first > at:
                    yield at, first
                if isinstance(node, ast.ClassDef):
                    yield from inside(node.body, first, last)
                else:
                    yield first, last
                at = last
        if end > at:
            yield at, end

    return list(inside(ast.parse(text).body, 0, len(text)))
