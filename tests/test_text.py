import re
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T

TEXTS = ["", "a", "\n", "a\n", "a\r\nb\rc", "\n\n a \x0b b\x0cc\x1cd\x1ee\x85f\u2028g\u2029", "é\U0001d54f\r\n\r\n", "x\n\ry"]


def col(spark, rows, *columns):
    return [tuple(x) for x in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(*columns).collect()]


def test_lines_are_those_of_splitlines(spark):
    got = col(spark, TEXTS, T.lines(F.col("t")), F.transform(T.lines(F.col("t")), T.without_end))
    assert [x[0] for x in got] == [x.splitlines(keepends=True) for x in TEXTS]
    assert [x[1] for x in got] == [[y.rstrip("\r\n") for y in x.splitlines(keepends=True)] for x in TEXTS]
    assert col(spark, ["a\r\nb\rc\n"], T.unix_lines(F.col("t"))) == [("a\nb\nc\n",)]


def test_white_space_and_words_are_python_s(spark):
    # without characters that an older Unicode version lacks, as Java's may be older
    chars = [chr(i) for i in range(1, sys.maxunicode + 1, 1) if not 0xD800 <= i < 0xE000 and (i < 0x3100 or i % 97 == 0) and unicodedata.ucd_3_2_0.category(chr(i)) != "Cn"]
    blank = col(spark, chars, T.is_blank(F.col("t")))
    assert [c for c, (x,) in zip(chars, blank) if x != (c.strip() == "")] == []
    word = col(spark, chars, F.col("t").rlike(T.WORD))
    wrong = [c for c, (x,) in zip(chars, word) if x != bool(re.match(r"\w", c))]
    assert wrong == []


@pytest.mark.parametrize(("text", "words"), [("Hello WORLD", ["hello", "world"]), ("a APP_RPC_TIMEOUT x", ["a", "app_rpc_timeout", "x"]), ("running runs", ["running", "runs"]), ("", []), ("É—ß", ["é", "ß"])])
def test_words(spark, text, words):
    assert col(spark, [text], T.words(F.col("t"))) == [(words,)]


def test_stop_words_go(spark):
    assert col(spark, ["The cat is on a mat"], T.terms(F.col("t"))) == [(["cat", "mat"],)]


@pytest.mark.parametrize(("line", "mark"), [("```python", ("`", 3)), ("~~~", ("~", 3)), ("   ````", ("`", 4)), ("    ```", None), ("``", None), ("a```", None)])
def test_fence_marks(spark, line, mark):
    assert col(spark, [line], T.fence(F.col("t")))[0][0] == mark


@pytest.mark.parametrize(("line", "closes"), [("```", True), ("````", True), ("```  ", True), ("~~~", False), ("``", False), ("``` x", False), ("    ```", False)])
def test_fence_ends(spark, line, closes):
    assert col(spark, [line], T.closes(F.col("t"), F.lit("`"), F.lit(3))) == [(closes,)]


@pytest.mark.parametrize(("line", "header"), [("# a", True), ("###", True), ("   ## a", True), ("#\ta", True), ("#5", False), ("    # a", False), ("\t# a", False), ("####### a", False), ("a # b", False)])
def test_headers(spark, line, header):
    assert col(spark, [line], T.is_header(F.col("t"))) == [(header,)]


@pytest.mark.parametrize(
    ("size", "limit", "overlap", "spans"),
    [(55, 20, 5, [(0, 20), (15, 35), (30, 50), (45, 55)]), (12, 20, 5, [(0, 12)]), (0, 20, 5, []), (20, 20, 5, [(0, 20)]), (5, 2, 9, [(0, 2), (1, 3), (2, 4), (3, 5)])],
)
def test_windows(spark, size, limit, overlap, spans):
    got = col(spark, ["x" * size], T.window_spans(F.lit(0), F.length("t"), limit, overlap))
    assert [tuple(x) for x in got[0][0]] == spans


def test_paths_sort_by_their_parts(spark):
    paths = ["a/cpu.md", "a/cpu/apple.md", "./a/b", "a//c"]
    got = spark.createDataFrame([(x,) for x in paths], "p string").orderBy(T.path_key(F.col("p"))).collect()
    assert [x.p for x in got] == ["./a/b", "a//c", "a/cpu/apple.md", "a/cpu.md"]
