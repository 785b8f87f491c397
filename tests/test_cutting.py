import ast
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.operators import cutting as C
from corpusmill.operators.chunking import checked_limit, spans_of

PIECES = st.lists(st.sampled_from(["a", "é", "\U0001d54f", " ", "\n", "\n\n", "\r\n", "\r", "\u2028", "```", "~~~~", "# h", "   ", "x" * 40, "\x0c"]), max_size=60).map("".join)


def cut(text, spans):
    return [text[a:b] for a, b in spans]


@pytest.mark.parametrize(
    ("text", "parts"),
    [("line one\nline two\nline three", ["line one\nline two\nline three"]), ("para one\n\n\n\npara two", ["para one", "para two"]), ("para one\n   \npara two", ["para one", "para two"]), ("\n\npara one\n\n", ["para one"]), ("", []), (" \n\n", [])],
)
def test_paragraphs(text, parts):
    assert cut(text, C.paragraphs(text)) == parts


@pytest.mark.parametrize(
    ("spans", "packed"),
    [([(0, 3), (3, 6), (6, 9)], [(0, 9)]), ([(0, 5), (5, 10), (10, 15)], [(0, 10), (10, 15)]), ([(0, 3), (3, 100)], [(0, 3), (3, 100)]), ([(0, 3), (8, 10)], [(0, 10)]), ([(0, 100), (101, 102)], [(0, 100), (101, 102)]), ([], [])],
)
def test_pack(spans, packed):
    assert C.pack(spans, 10) == packed


def test_long_lines_take_windows_and_tell():
    told = []
    spans = list(C.fragments("x" * 500, 0, 500, 100, too_long=told.append))
    assert told == [500] and spans[:2] == [(0, 100), (90, 190)] and spans[-1][1] == 500 and all(b - a <= 100 for a, b in spans)
    assert list(C.fragments("ab", 0, 2, 100, split=lambda t, a, b: [(0, 1), (1, 2)])) == [(0, 2)]


def test_markdown_blocks():
    text = "intro\n\n```py\na\n\nb\n```\noutro"
    assert cut(text, C.markdown_blocks(text)) == ["intro", "```py\na\n\nb\n```", "outro"]
    assert cut("a\n```\nb", C.markdown_blocks("a\n```\nb")) == ["a", "```\nb"]
    assert cut("~~~\n```\n~~~~\nx", C.markdown_blocks("~~~\n```\n~~~~\nx")) == ["~~~\n```\n~~~~", "x"]


def test_sections():
    assert C.header_offsets("# H1\n\ntext\n\n## H2\n") == [0, 12]
    text = "intro text\n\n# H1\n\nbody\n"
    assert cut(text, C.sections(text)) == ["intro text\n\n", "# H1\n\nbody\n"]
    assert cut("no header\n", C.sections("no header\n")) == ["no header\n"] and C.sections("") == []
    assert cut("```\n# no\n```\n", C.sections("```\n# no\n```\n")) == ["```\n# no\n```\n"]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("X = 1\n\ndef foo():\n    pass\n\nY = 2\n", ["X = 1\n\n", "def foo():\n    pass", "\n\nY = 2\n"]),
        ("A = 1\nB = 2\n", ["A = 1\nB = 2\n"]),
        ("@a\n@b.c(1)\ndef foo():\n    pass\n", ["@a\n@b.c(1)\ndef foo():\n    pass", "\n"]),
        ("@ a\ndef foo(): pass", ["@ a\ndef foo(): pass"]),
        ("class A:\n    x = 1\n", ["class A:\n    x = 1", "\n"]),
        ("class A:\n    x = 1\n\n    def f(self):\n        def g(): pass\n", ["class A:\n    x = 1\n\n    ", "def f(self):\n        def g(): pass", "\n"]),
        ("if x:\n    def f(): pass\n", ["if x:\n    def f(): pass\n"]),
        ("def f(): return 'é'\nx = 1", ["def f(): return 'é'", "\nx = 1"]),
        ("x = '''\x0c\u2028'''\ndef f(): pass", ["x = '''\x0c\u2028'''\n", "def f(): pass"]),
        ("", []),
    ],
)
def test_definitions(text, parts):
    assert cut(text, C.definitions(text)) == parts


def test_columns_as_bytes_overshoot():
    text = "def f(): return 'é'\nx = 1"
    assert cut(text, C.definitions(text, byte_columns=True)) == ["def f(): return 'é'\n", "x = 1"]


def test_a_text_that_does_not_parse_has_a_diagnostic():
    for text in ("print 1", "\ufeffx = 1\n(", "x\x00", "(" * 3000):
        spans, notes = spans_of(text, "py", 100)
        assert spans == [] and [x[0] for x in notes] == ["unparsable"]


@settings(max_examples=150, deadline=None)
@given(PIECES, st.sampled_from(["txt", "md"]), st.integers(1, 60))
def test_chunks_keep_limit_and_order_and_lose_no_text(text, ext, limit):
    spans, _ = spans_of(text, ext, limit)
    assert all(0 <= a < b <= len(text) and b - a <= limit for a, b in spans)
    assert spans == sorted(spans)
    held = set()
    for a, b in spans:
        held.update(range(a, b))
    assert all(i in held for i, c in enumerate(text) if c.strip())


@settings(max_examples=100, deadline=None)
@given(PIECES)
def test_sections_tile_and_lines_and_packs_agree(text):
    sections = C.sections(text)
    assert "".join(cut(text, sections)) == text
    assert C.pack(C.pack(sections, 50), 50) == C.pack(sections, 50)
    lines = list(C.line_bounds(text))
    assert cut(text, lines) == [x.rstrip("\r\n") for x in text.splitlines(keepends=True)]


def test_units_of_real_code_tile_it():
    rng = random.Random(1)
    for module in rng.sample([ast, random, C], 3):
        text = open(module.__file__, encoding="utf-8").read()
        assert "".join(cut(text, C.definitions(text))) == text


@pytest.mark.parametrize("limit", [0, 2001, -1, "5", 1.5, None, True])
def test_limits(limit):
    with pytest.raises(ValueError):
        checked_limit(limit)
