import random

import pytest

from corpusmill.llm.splitting import split, split_chunks


def test_pieces_keep_limit_overlap_and_text():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abé \n.𝕏") if rng.random() < 0.3 else "x" for _ in range(rng.randrange(400)))
        limit, overlap = rng.randrange(1, 60), rng.randrange(0, 70)
        spans = split(text, limit, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(b - a <= limit for a, b in spans)
        assert all(x[1] - y[0] == min(overlap, limit - 1) for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize(
    ("text", "limit", "overlap", "pieces"),
    [
        ("a" * 10, 10, 0, ["a" * 10]),
        ("a" * 11, 10, 0, ["a" * 6, "a" * 5]),
        ("one two\n\nthree four", 15, 0, ["one two\n\n", "three four"]),
        ("one two three four", 12, 0, ["one two ", "three four"]),
        ("x = 1\n\ny = 2\ndef f():\n    z", 24, 0, ["x = 1\n\ny = 2\n", "def f():\n    z"]),
        ("# a\n\ntext\n## b\ntext", 16, 0, ["# a\n\ntext\n", "## b\ntext"]),
        ("abcdefghij", 6, 2, ["abcdef", "efghij"]),
    ],
)
def test_cuts_at_natural_boundaries(text, limit, overlap, pieces):
    assert [text[a:b] for a, b in split(text, limit, overlap)] == pieces


def test_limits_of_runs(spark):
    chunks = spark.createDataFrame([(1, "x" * 2000, 1), (2, "x" * 2001, 1), (3, "é" * 21, 2), (4, "é" * 20, 2), (5, None, 2), (6, "x" * 9999, 9), (7, "x" * 9999, None)], "chunk_id bigint, content string, run_id int")
    runs = spark.createDataFrame([(1, None, None), (2, 20, None)], "run_id int, max_chunk_size int, overlap int")
    rows = sorted(split_chunks(chunks, runs).collect())
    assert [(x.chunk_id, x.piece, x["first"], x["last"]) for x in rows] == [(2, 0, 0, 1101), (2, 1, 901, 2001), (3, 0, 0, 12), (3, 1, 10, 21)]
    assert all(len(x.content) == x["last"] - x["first"] for x in rows)


def test_nulls_repeats_and_other_columns(spark):
    schema = "chunk_id bigint, content string, run_id int, limit int, piece string"
    chunks = spark.createDataFrame([(None, "x" * 99, 1, 5, "a"), (1, "", 1, None, None), (2, "ab " * 40_000, 1, 5, "a"), (3, "abcdef", 1, 1, None), (3, "abcdef", 1, 1, None)], schema)
    runs = spark.createDataFrame([(1, 5, 9, 7), (1, 5, 9, 7), (None, 1, 1, 1), (2, -1, -5, 0)], "run_id int, max_chunk_size int, overlap int, limit int")
    rows = split_chunks(chunks, runs).collect()
    assert {x.chunk_id for x in rows} == {2, 3} and max(len(x.content) for x in rows) <= 5
    assert sorted((x.piece, x["first"], x["last"]) for x in rows if x.chunk_id == 3) == [(0, 0, 5), (0, 0, 5), (1, 1, 6), (1, 1, 6)]
    assert split_chunks(chunks.limit(0), runs).count() == 0 and split_chunks(chunks, runs.limit(0)).count() == 0
