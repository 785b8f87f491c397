import pytest

from corpusmill.operators import answering, evaluation, metrics

SOURCE = "array<struct<file_path:string,first_character_index:int,last_character_index:int>>"


def test_recall_counts_overlaps_and_not_touching(spark):
    asked = spark.createDataFrame(
        [("q1", "x", [("a", 0, 10), ("a", 0, 10), ("b", 5, 9)], "y"), ("q1", "x", [("a", 0, 10), ("a", 0, 10), ("b", 5, 9)], "y"), ("q2", "x", [("a", 0, 10)], "y"), ("q3", "x", None, None), ("q4", "x", [], "y"), ("q5", "x", [("a", 0, None)], None)],
        f"question_id string, question string, sources {SOURCE}, answer string",
    )
    results = [("q1", 1, 0.5, "a", 10, 20), ("q1", 2, 0.4, "a", 9, 20), ("q1", 2, 0.1, "a", 9, 20), ("q1", 3, 0.3, "b", 0, 6), ("q1", 4, None, "b", 0, 6), ("q1", 5, float("nan"), "b", 0, 6), (None, 6, 0.9, "a", 0, 9), ("q1", None, 0.9, None, None, None), ("q3", 1, 0.9, "a", 0, 3)]
    retrieved = evaluation.retrieved_sources(spark.createDataFrame(results, "question_id string, chunk_id bigint, score double, file_path string, first_character_index int, last_character_index int"))
    assert [(x.chunk_id, x["rank"]) for x in retrieved.where("question_id = 'q1'").orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    correct = evaluation.correct_sources(asked)
    per = {x.question_id: tuple(x)[1:] for x in evaluation.recall(retrieved, correct).collect()}
    assert per == {"q1": (2, 0.0, 1.0, 1.0, 1.0), "q2": (1, 0.0, 0.0, 0.0, 0.0)}
    row = evaluation.verdict(evaluation.recall(retrieved, correct)).first()
    assert row.n_questions == 2 and row.recall_at_5 == 0.5 and row.passed
    assert not evaluation.verdict(evaluation.recall(retrieved, correct), evaluation.DOCS_LEAST).first().passed
    assert evaluation.verdict(evaluation.recall(retrieved, correct.limit(0))).first().passed is False
    assert evaluation.answered(asked).count() == 3
    assert {x.chunk_id for x in evaluation.too_long(retrieved, 10).collect()} == {2}


def test_metrics(spark):
    chunks = spark.createDataFrame([("md", 0, 4), ("md", 0, 1), ("md", 0, 3), ("md", 0, 2), ("py", 0, None)], "ext string, first_character_index int, last_character_index int")
    files = spark.createDataFrame([("a", "md"), ("a", "md"), ("b", "md"), ("c", "py")], "file_path string, ext string")
    rows = metrics.chunk_metrics(chunks, files).collect()
    assert [x.asDict() for x in rows] == [{"ext": "md", "n_chunks": 4, "min_size": 1, "max_size": 4, "avg_size": 2.5, "median_size": 2.5, "n_files": 2, "chunks_per_file": 2.0}]


def test_contexts_and_answers(spark):
    results = spark.createDataFrame([("q1", 2, 7), ("q1", 1, 8), ("q2", 1, 9)], "question_id string, rank int, chunk_id bigint")
    texts = spark.createDataFrame([(7, "seven"), (8, "eight")], "chunk_id bigint, content string")
    held = answering.contexts(results, texts, 9)
    assert [tuple(x) for x in held.collect()] == [("q1", "eight\n\nse")]
    asked = spark.createDataFrame([("q1", "a"), ("q2", "b")], "question_id string, question string")
    assert sorted(map(tuple, answering.answers(asked, held).collect())) == [("q1", "a", "eight"), ("q2", "b", "")]
    assert answering.answers(asked, held, lambda q, c: q.upper()).orderBy("question_id").first().answer == "A"


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_thresholds(spark, least):
    row = spark.createDataFrame([("q", 1, 1.0, 1.0, 1.0, 1.0)], "question_id string, n_sources int, recall_at_1 double, recall_at_3 double, recall_at_5 double, recall_at_10 double")
    assert evaluation.verdict(row, least).first().passed
