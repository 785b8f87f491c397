import random

import pytest

from corpusmill.llm.origin import FEATURES, features, header, minified, not_handwritten, notice, scored

SCHEMA = "file_path string, ext string, content string, notice int"


@pytest.mark.parametrize(
    ("head", "kind"),
    [
        ("# Code generated by toolname from a.proto. DO NOT EDIT.", "machine"), ("# @generated 0a1b", "machine"), ("# This module is autogenerated, run `make x` to refresh it.", "machine"),
        ('"""Bindings for x. Produced automatically from a.idl; manual changes will be lost."""', "machine"), ("# Generated by hand-tool 1.0", "machine"), ("# THIS FILE WAS AUTOMATICALLY GENERATED BY x", "machine"),
        ("# Every generated token is checked against the list; edit with care.", None), ('"""Generates code that is generated by others."""', None), ("# Helpers for generated code", None), ('"""Vendors of parts, as a list."""', None),
        ('"""Vendored copy of a.b, release 1.2."""', "copied"), ("# Copied unchanged from a 1.2; please send fixes upstream.", "copied"), ("# upstream: a-1.2, imported as is", "copied"),
        ("# Copyright (c) 2014 the A team\n# Distributed with a 1.2 under its own licence.", "copied"), ("# Copied from a 1.2", "copied"), ("# The loop below was copied from a 1.2.", None), ("# The idea is taken from another project.", None), ("# One routine was adapted from a 1.2.", None),
        ('"""Lookup data."""', "data"), ("# token table", "data"), ('"""Lookup data of the scheduler, read at startup."""', None),
        ("# SPDX-License-Identifier: MIT", "own"), ("# SPDX-License-Identifier: MIT\n# Code generated by x.", "machine"), ("", None), ("x = '# Code generated by y'", None),
    ],
)
def test_notices(head, kind):
    assert notice(header(head + "\n\nx = 1\n")[0]) == kind


def test_header_is_comments_and_docstring():
    assert header("﻿# a\n\n'''b\n'''  # c\n# d\nx = 1\n") == ("﻿# a\n\n'''b\n'''  # c\n# d\n", "x = 1\n")
    assert header("") == ("", "") and header("# a") == ("# a", "") and header("x = 'a'\n") == ("", "x = 'a'\n")
    assert header('"""never closed\n')[0] == ""


def test_features_are_numbers_for_any_text():
    for body in ("x", "é\n" * 5, "\ud800", "a" * 200_000, ";;;", "\x00\r\x0c"):
        assert len(features(body)) == len(FEATURES) and all(x == x for x in features(body))
    assert minified("def f(long_name):  # no\n    return long_name\n") == "def a(b):return b\n"


def written(rng):
    words = ["scheduler", "token", "cache", "window", "buffer", "request", "offset", "loader"]
    body = "".join(f"\n\ndef {rng.choice(words)}_{rng.choice(words)}({rng.choice(words)}, limit=None):\n    # keep the {rng.choice(words)} of the {rng.choice(words)} together\n    if {rng.choice(words)} is None:\n        return {rng.choice(words)}.{rng.choice(words)}(limit)\n    return {rng.choice(words)}[{rng.randrange(9)}]\n" for _ in range(rng.randrange(5, 15)))
    return f"import {rng.choice(words)}\n{body}"


def table(rng):
    return "VALUES = [\n" + "".join(f"    [{', '.join(f'{rng.random():.5f}' for _ in range(8))}],\n" for _ in range(rng.randrange(30, 90))) + "]\n"


def test_files_that_nobody_wrote(spark):
    rng = random.Random(4)
    rows, cases = [], set()

    def add(path, content, case, ext="py"):
        rows.append((path, ext, content, 1))
        if case:
            cases.add(path)

    for i in range(160):
        add(f"raw/core/h{i}.py", "# SPDX-License-Identifier: MIT\n" + written(rng), False)
        add(f"raw/{'vendor_checks' if i % 4 == 0 else 'tools'}/u{i}.py", written(rng), False)
        if i < 40:
            add(f"raw/core/t{i}.py", '"""Lookup data."""\n' + table(rng), True)
            add(f"raw/core/d{i}.py", table(rng), True)
            add(f"raw/core/m{i}.py", minified(written(rng)), True)
        if i < 15:
            add(f"raw/x{i}/third_party/c{i}.py", written(rng), True)
            add(f"raw/borrowed/b{i}.py", ("# Copied unchanged from a 1.2.\n" if i % 2 else "") + written(rng), True)
    add("raw/core/t0.py", rows[2][2], True)
    rows += [("raw/core/null.py", "py", None, 1), ("raw/core/empty.py", "py", "", 1), ("raw/core/blank.py", "py", " \n", 1), (None, "py", "x = 1", 1), ("raw/core/x.md", "md", "# @generated", 1), ("raw/core/head.py", "py", "# @generated\n", 1)]
    got = {x.file_path for x in not_handwritten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got >= cases | {"raw/core/head.py"}
    assert len(got - cases) <= 4


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scored(empty).count() == 0
    one = spark.createDataFrame([("a.py", "py", "x = 1", 1)], SCHEMA)
    assert [tuple(x)[2:] for x in scored(one).collect()] == [(None, 0.0, False)]
