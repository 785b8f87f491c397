import random

import pytest

from corpusmill.errors import ChunkError
from corpusmill.operators import chunking, cutting, order, spans

SCHEMA = "file_path string, ext string, content string, loaded_at int"


def random_files(n=40):
    rng = random.Random(9)
    bits = ["a b", "", "  ", "# h", "```", "x" * 30, "é\u2028b", "def f():\n    pass\n", "y = 1"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(bits) + rng.choice(["\n", "\n", "\r\n", "\x0b", "\n\n"]) for _ in range(rng.randrange(30)))
        rows.append((f"d/{i % 7}/f{i}.{['txt', 'md', 'py'][i % 3]}", ["txt", "md", "py"][i % 3], text, i))
    return rows + [("n.md", "md", None, 1), ("e.txt", "txt", "", 1), (None, "txt", "lost", 1), ("x.rst", "rst", "a", None), rows[0][:3] + (99,)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(random_files(), SCHEMA)


def truth(make):
    return sorted({(p, *x) for p, _, t, _ in random_files() if t is not None for x in make(t)}, key=str)


def test_relational_spans_are_those_of_the_text_functions(files):
    assert sorted((tuple(x) for x in spans.line_spans(files).collect()), key=str) == truth(lambda t: [(i, *x) for i, x in enumerate(cutting.line_bounds(t))])
    assert sorted((tuple(x) for x in spans.paragraph_spans(files).collect()), key=str) == truth(cutting.paragraphs)


def test_windows_over_texts(spark):
    rows = spark.createDataFrame([(1, "x" * 45), (2, ""), (3, None)], "doc_id bigint, text string")
    assert [tuple(x) for x in spans.text_windows(rows, "doc_id", "text", 20, 5).orderBy("first").collect()] == [(1, 0, 20), (1, 15, 35), (1, 30, 45)]


def test_chunks_of_files(files):
    got = chunking.chunk_files(files, 50).collect()
    contents = {p: t for p, _, t, _ in random_files()}
    assert all(x.content == contents[x.file_path][x.first_character_index : x.last_character_index] and 0 < len(x.content) <= 50 for x in got)
    expected = {(p, *s) for p, e, t, _ in random_files() if t is not None and e in ("txt", "md", "py") for s in chunking.spans_of(t, e, 50)[0]}
    assert {(x.file_path, x.first_character_index, x.last_character_index) for x in got} == expected and len(got) == len(expected)


def test_diagnostics(spark):
    rows = [("a.py", "py", "print 1", 1), ("a.txt", "txt", "x" * 99, 1)]
    got = chunking.diagnostics(spark.createDataFrame(rows, SCHEMA), 50).collect()
    assert sorted((x.file_path or "", x.kind) for x in got) == [("", "no files"), ("a.py", "unparsable"), ("a.txt", "long line")]
    with pytest.raises(ChunkError):
        chunking.require_files(spark.createDataFrame([("a.rst", "rst", "x", 1)], SCHEMA))


def test_numbers_follow_the_order_of_an_index(files):
    chunks = chunking.chunk_files(files, 50)
    rows = order.number_chunks(chunks).orderBy("chunk_id").collect()
    key = lambda x: (["txt", "md", "py"].index(x.ext), [y for y in (x.file_path or "").split("/") if y not in ("", ".")], x.first_character_index)
    assert [x.chunk_id for x in rows] == list(range(len(rows))) and [key(x) for x in rows] == sorted(map(key, rows))
    assert order.number_chunks(chunks.limit(0)).count() == 0


def test_a_splitter_of_one_s_own(spark):
    files = spark.createDataFrame([("a.txt", "txt", "one;two;three", 1)], SCHEMA)

    def parts(text, start, end):
        at = start
        for piece in text[start:end].split(";"):
            yield at, at + len(piece)
            at += len(piece) + 1

    got = chunking.chunk_files(files, 5, split=parts).orderBy("position").collect()
    assert [x.content for x in got] == ["one", "two", "three"]


def test_table_function_in_sql(spark):
    from corpusmill.functions.registry import register

    register(spark)
    got = spark.sql("select k, position, c.content from values (1, 'one\n\ntwo'), (2, null) as t(k, content), lateral chunk_spans(t.content, 'txt', 4) as c").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "one"), (1, 1, "two")]
