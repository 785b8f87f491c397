import random

import numpy as np
import pytest

from corpusmill.operators import bm25, ranking
from corpusmill.plans import QUERIES

CHUNK = "chunk_id bigint, file_path string, first_character_index int, last_character_index int, content string"
QUESTION = "question_id string, question string"


def moved(spark):
    """Rows that all stages so far wrote for shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["bm25_topk", "context_assembly", "answers", "search_sources", "search_results_nested"])
def test_no_row_for_each_chunk_that_shares_a_term_with_a_question(spark, tmp_path, name):
    spark.createDataFrame([(i, f"{i}.md", 0, 9, f"common words {i}") for i in range(400)], CHUNK).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(f"q{i}", f"common words w{i}") for i in range(400)], QUESTION).write.parquet(f"{tmp_path}/rag_questions.parquet")
    before, most = moved(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for more questions
    try:
        rows = QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert len(rows) == (400 if name in ("context_assembly", "answers") else 2000)
    assert moved(spark) - before < 40_000  # of 160,000 such pairs


@pytest.mark.parametrize("postings, group", [(4_000_000, 500), (60, 3)])
def test_blocks_and_groups_give_the_best_of_all(spark, monkeypatch, postings, group):
    monkeypatch.setattr(ranking, "POSTINGS", postings)
    monkeypatch.setattr(ranking, "LEAST_GROUP", group)
    some = random.Random(postings)
    word = lambda: f"w{min(int(some.expovariate(0.2)), 30)}"
    texts = [" ".join(word() for _ in range(some.randrange(12))) for _ in range(70)]
    chunks = spark.createDataFrame([(i * 7 % 101, "a", 0, 1, texts[i % 50]) for i in range(70)], CHUNK)  # copies tie
    questions = spark.createDataFrame([(f"q{i}", " ".join(word() for _ in range(some.randrange(7)))) for i in range(40)], QUESTION)
    scores = {}
    for x in bm25.posting_scores(chunks).collect():
        scores.setdefault(x.term, {})[x.chunk_id] = x.score
    expected = set()
    for q, text in questions.collect():
        sums = {}
        for term in text.split():
            for chunk, score in scores.get(term, {}).items():
                sums[chunk] = sums.get(chunk, 0) + score
        best = sorted((-round(s, 6), c) for c, s in sums.items())[:4]
        expected |= {(q, r + 1, c, round(-s, 6)) for r, (s, c) in enumerate(best)}
    for found in (bm25.ranked_chunks(chunks, questions, 4), bm25.ranked(bm25.posting_scores(chunks), questions, 4)):
        assert {(x.question_id, x["rank"], x.chunk_id, round(x.score, 6)) for x in found.collect()} == expected


def test_a_question_after_another_begins_with_its_own_sums():
    docs, terms, scores = np.array([0, 1, 0, 2, 1, 2, 2]), np.array([0, 0, 1, 1, 2, 2, 2]), np.array([1.0, 2, 4, 1, 1, 1, 2])
    block = ranking.Block(docs, terms, scores, 3, np.arange(3), 2)
    for bag, expected in ((((0, 1), (1, 1)), [(0, 5.0), (1, 2.0)]), (((0, 1),), [(1, 2.0), (0, 1.0)]), (((0, 2), (2, 1)), [(1, 5.0), (2, 3.0)]), (((1, 1), (2, 1)), [(0, 4.0), (2, 4.0)])):
        found, units = block.best(bag)
        assert list(zip(found.tolist(), (units / 10**ranking.PLACES).tolist())) == expected


def test_a_chunk_without_an_id_is_no_result(spark):
    chunks = spark.createDataFrame([(None, "a", 0, 1, "word"), (1, "a", 0, 1, "word other")], CHUNK)
    questions = spark.createDataFrame([("q", "word")], QUESTION)
    assert [x.chunk_id for x in bm25.ranked_chunks(chunks, questions, 3).collect()] == [1]
