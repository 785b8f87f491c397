import pytest

from corpusmill.llm.documentation import documented
from corpusmill.llm.pysource import clean_documentation, functions, is_trivial, parses


@pytest.mark.parametrize(
    "text",
    [
        "Placeholder for unavailable DeepGEMM backend.",
        "Add the given document to the index and return its id.",
        "Write the description of the model to the config file.",
        "Hack around the missing kernel of older devices.",
        "No documents are read before the first flush.",
        "TODO: add docs later.\n\nReturns the width of one row in bytes.",
        "TODO: support the packed layout of older devices",
    ],
)
def test_real_documentation_is_no_placeholder(text):
    assert not is_trivial("_missing", text)


@pytest.mark.parametrize(
    "text",
    [
        "FIXME add a proper description here later",
        "TODO(docs): describe the arguments of this function",
        "TODO: explain what this one is for",
        "Add a docstring for this function.",
        "Documentation to be written later on",
        "Placeholder docstring, to be written",
        "No documentation for this method yet.",
        "TBD TBD TBD TBD",
    ],
)
def test_note_that_documentation_is_missing_is_trivial(text):
    assert is_trivial("_missing", text)


def test_string_directly_after_a_keyword():
    source = 'def a():\n    return"("\n\ndef b(c):\n    if c in"([":\n        return"""\n    def no(): pass\n"""\n\ndef d(): pass\n'
    assert parses(source)
    assert [x.qualname for x in functions(source)] == ["a", "b", "d"]


@pytest.mark.parametrize("line", ["# Region of the cache that is swapped out next", "# No coverage is computed for skipped rows", "# Type: kind of the value", "# Black: the colour of an empty cell"])
def test_prose_is_no_directive(line):
    assert clean_documentation(line, "comment above") == line[2:]


@pytest.mark.parametrize(
    "line",
    [
        "# noqa: E501", "# type: ignore[misc]", "# type: (int, str) -> bool", "# type: List[int]", "# pylint: disable=too-many-lines", "# mypy: allow-untyped-defs", "# fmt: off", "#region Cache",
        "#endregion", "# pragma: no cover", "# no cover", "# isort:skip_file", "# ruff: noqa: E501", "# -*- coding: utf-8 -*-", "# coding: utf-8", "#!/usr/bin/env python", "# pyre-fixme[6]: for the parser", "# nosec B101", "# NOLINT",
        "# pyright: basic, reportPrivateUsage=false", "# cython: language_level=3", "# doctest: +SKIP", "# noinspection PyUnusedLocal", "# sourcery skip: low-code-quality", "# cspell:ignore kiplogri",
    ],
)
def test_directive_is_no_documentation(line):
    assert clean_documentation(line, "comment above") == ""


def test_byte_order_mark():
    source = '\ufeffdef a():\n    """Gives the width of one row."""\n'
    assert parses(source) and not parses("\ufeff" + source)
    assert [x[0] for x in documented(source)] == ["a"]


@pytest.mark.parametrize(
    "line",
    [
        r"x = rf'\{{('", r"x = f'\{y}('", r"x = rf'\{y}('", "x = f'\\N{BULLET}('", "x = f'''{\n    y  # it's (\n}'''", "x = f\"{y:{z}}(\"", "x = f'{{('", r"x = rf'\'('", "x = f'{y!r:>{w}}('", "x = f'{y[\"(\"]}'",
    ],
)
def test_formatted_strings_end_where_they_end(line):
    assert parses(line + "\n")
    assert [x.qualname for x in functions(line + "\n\ndef after(): pass\n")] == ["after"]


def test_names_are_those_that_python_has():
    assert [x.qualname for x in functions("def ﬁx(): pass\n")] == ["fix"]


def test_a_line_of_a_string_is_no_comment():
    source = 'x = """\n# Counts the rows that were read."""\ndef f(): pass\n'
    assert functions(source)[0].documentation is None
    assert functions("# Counts the rows that were read.\r\n@a\r\n@b\r\ndef f(): pass\r\n")[0].documentation == "# Counts the rows that were read."
    assert functions("# Counts the rows.\n\ndef f(): pass\n")[0].documentation is None


def test_an_example_is_no_code():
    assert clean_documentation("# e.g. foo(bar) is a call", "comment above") == "e.g. foo(bar) is a call"
    assert clean_documentation("# x = foo(bar)", "comment above") == ""


def test_names_and_docstrings_are_those_of_the_syntax_tree():
    import ast
    import random
    import sysconfig
    from pathlib import Path

    def walk(body, prefix):
        for x in ast.iter_child_nodes(body):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                if not isinstance(x, ast.ClassDef):
                    yield prefix + x.name, ast.get_docstring(x, clean=False)
                yield from walk(x, prefix + x.name + ".")
            else:
                yield from walk(x, prefix)

    files = sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))
    for path in random.Random(3).sample(files, 60):
        text = path.read_text(encoding="utf-8")
        got = [(x.qualname, x.documentation if x.origin == "docstring" else None) for x in functions(text)]
        assert sorted(got, key=str) == sorted(walk(ast.parse(text), ""), key=str), path


def test_time_is_in_proportion_to_length():
    import time

    took = []
    for n in (4_000, 32_000):
        text = "# Counts the rows that were read.\ndef f():\n    # one\n    pass\n\n" * n
        begun = time.process_time()
        functions(text)
        took.append(time.process_time() - begun)
    assert took[1] < 20 * took[0]
