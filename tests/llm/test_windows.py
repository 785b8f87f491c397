import random

from corpusmill.llm.windows import anchors, reappearances, shared_passages, shared_spans


def text(rng, n):
    return "".join(rng.choice("abcdé𝕏 \n") for _ in range(n))


def test_passages_of_200_characters_are_found_and_of_199_are_not(spark):
    rng = random.Random(5)
    p, runs = text(rng, 200), "x" * 450
    rows = [
        (1, text(rng, 37) + p + text(rng, 300)), (2, text(rng, 411) + p), (3, text(rng, 50) + "|" + p[1:] + "|" + text(rng, 50)), (4, p[:-1]), (5, None), (6, ""),
        (7, runs), (8, text(rng, 60) + "x" * 200), (9, "x" * 199), (10, p),
    ]
    got = shared_passages(spark.createDataFrame(rows, "chunk_id bigint, content string")).collect()
    assert sorted((x.chunk_id_a, x.chunk_id_b) for x in got) == [(1, 2), (1, 10), (2, 10), (7, 8)]
    assert {(x.chunk_id_a, x.chunk_id_b): [tuple(y) for y in x.spans_a] for x in got}[1, 2] == [(37, 237)]
    by = {x.chunk_id: x for x in reappearances(spark.createDataFrame(rows, "chunk_id bigint, content string")).collect()}
    assert by[10].share == 1 and by[10].partners == [1, 2] and by[7].share == 1 and by[1].share == 200 / 537 and sorted(by) == [1, 2, 7, 8, 10]


def test_repeated_rows_nulls_and_other_columns(spark):
    rng = random.Random(8)
    p = text(rng, 260)
    rows = [(1, p, "x", 1), (1, p, "x", 1), (2, text(rng, 20) + p, None, 2), (None, p, "x", 3), (3, text(rng, 30_000) + p[:230], "y", None), (4, None, "y", 4)]
    frame = spark.createDataFrame(rows, "chunk_id bigint, content string, anchor string, length_a int")
    got = shared_passages(frame).collect()
    assert sorted((x.chunk_id_a, x.chunk_id_b, [tuple(y) for y in x.spans_a]) for x in got) == [(1, 2, [(0, 260)]), (1, 3, [(0, 230)]), (2, 3, [(20, 250)])]
    assert {x.chunk_id: (x.partners, round(x.share, 4)) for x in reappearances(frame).collect()} == {1: ([2, 3], 1.0), 2: ([1, 3], round(260 / 280, 4)), 3: ([1, 2], round(230 / 30_230, 4))}
    assert shared_passages(frame.limit(0)).count() == 0 and reappearances(frame.limit(0)).count() == 0


def test_copies_are_compared_once_and_lose_no_pair(spark):
    rng = random.Random(9)
    p, q = text(rng, 240), text(rng, 300)
    rows = [(9, p + q), (2, p + q), (5, text(rng, 30) + p), (1, q + "|"), (7, q + "|"), (4, text(rng, 500)), (3, p + q)]
    frame = spark.createDataFrame(rows, "chunk_id bigint, content string")
    content = dict(rows)
    expected = {(a, b) for a in content for b in content if a < b and shared_spans(content[a], content[b])[0]}
    got = {(x.chunk_id_a, x.chunk_id_b): x for x in shared_passages(frame).collect()}
    assert set(got) == expected and len(expected) == 3 + 3 + 6 + 1
    for (a, b), x in got.items():
        assert ([tuple(y) for y in x.spans_a], [tuple(y) for y in x.spans_b]) == shared_spans(content[a], content[b])
        assert (x.length_a, x.length_b) == (len(content[a]), len(content[b]))
    by = {x.chunk_id: x for x in reappearances(frame).collect()}
    assert {i: x.partners for i, x in by.items()} == {i: sorted({a + b - i for a, b in expected if i in (a, b)}) for i in (1, 2, 3, 5, 7, 9)}
    assert by[9].share == 1 and [tuple(x) for x in by[5].spans] == [(30, 270)]


def test_any_shared_passage_keeps_an_anchor():
    rng = random.Random(6)
    for _ in range(60):
        p = text(rng, 200) if rng.random() < 0.7 else ("ab" * 100)
        texts = [text(rng, rng.randrange(300)) + p + text(rng, rng.randrange(300)) for _ in range(2)]
        a, b = anchors([text(rng, rng.randrange(250)), *texts, "short"])[1:3]
        assert set(a.tolist()) & set(b.tolist()) and shared_spans(*texts)[0]
