"""Python's rules for lines, white space and words, as Spark expressions.

Java's own classes differ: its ``\\s``, ``\\R`` and ``\\w`` know fewer characters, and ``trim`` only
strips blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at which str.splitlines() ends a line; \r\n ends one line.
NEWLINES = r"\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029"
#: Characters that str.strip() strips.
SPACES = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE = rf"[^{NEWLINES}]*(?:\r\n|[{NEWLINES}])|[^{NEWLINES}]+"
WORD = r"[\p{L}\p{N}_]+"
FENCE = r"^ {0,3}(`{3,}|~{3,})"
HEADER = rf"^ {{0,3}}#{{1,6}}(?:[{SPACES}]|\z)"
#: The English stop words of the Lucene analyzers.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def lines(text: Column) -> Column:
    """The lines of a text with their ends; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def without_end(line: Column) -> Column:
    r"""A line without the \r and \n at its end; other line ends stay."""
    return F.regexp_replace(line, r"[\r\n]+\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"^[{SPACES}]*\z")


def unix_lines(text: Column) -> Column:
    """The text as a reader in text mode gives it."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def fence(line: Column) -> Column:
    """fence_char and fence_len if the line can open or close a fenced block, else null."""
    mark = F.regexp_extract(line, FENCE, 1)
    return F.when(mark != "", F.struct(F.substring(mark, 1, 1).alias("fence_char"), F.length(mark).alias("fence_len")))


def closes(line: Column, char: Column, length: Column) -> Column:
    """Whether the line closes a block that `length` times `char` opened."""
    mark = F.regexp_extract(line, FENCE, 1)
    rest = F.regexp_replace(line, FENCE, "")
    return (mark != "") & (F.substring(mark, 1, 1) == char) & (F.length(mark) >= length) & is_blank(rest)


def is_header(line: Column) -> Column:
    return line.rlike(HEADER)


def words(text: Column) -> Column:
    """The words of a text in lower case; an underscore is part of a word, and nothing is stemmed."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def terms(text: Column) -> Column:
    """The words without stop words."""
    return F.filter(words(text), lambda x: ~x.isin(*STOP_WORDS))


def path_key(path: Column) -> Column:
    """Sorts paths by their components, as pathlib does."""
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def window_spans(first: Column, last: Column, limit: int, overlap: int) -> Column:
    """Windows over [first, last) of at most `limit`, each `overlap` into the one before; none over nothing."""
    step = max(limit - overlap, 1)
    count = F.when(last <= first, 0).otherwise(F.ceil(F.greatest(last - first - limit, F.lit(0)) / step) + 1).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct((first + i * step).cast("int").alias("first"), F.least(first + i * step + limit, last).cast("int").alias("last")))
    return F.slice(windows, F.lit(1), count)
