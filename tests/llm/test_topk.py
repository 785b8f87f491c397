import random

from corpusmill.llm.topk import LoserTree, best_chunks

SCHEMA = "result_id bigint, question_id string, chunk_id bigint, score double, k int"


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for n in range(8):
        runs = [sorted((rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(6))) for _ in range(n)]
        assert list(LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_best_chunks_are_those_of_a_plain_sort(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big", "big", "big", "a", "b", None]), rng.choice([None, *range(30)]), rng.choice([None, float("nan"), float("inf"), -1.0, *[rng.randrange(6) / 2] * 4]), 0) for i in range(900)]
    k = {"big": 7, "a": 1, "b": 99, None: 3}
    rows = [(*x[:4], k[x[1]]) for x in rows]
    best: dict = {}
    for _, q, c, s, _ in rows:
        if q is not None and c is not None and s is not None and s == s:
            best[q, c] = max(s, best.get((q, c), s))
    expected = []
    for q in ("big", "a", "b"):
        expected += [(q, c, i + 1) for i, (_, c) in enumerate(sorted((-s, c) for (p, c), s in best.items() if p == q)[: k[q]])]
    got = best_chunks(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((x.question_id, x.chunk_id, x["rank"]) for x in got) == sorted(expected)


def test_many_partitions_make_many_buckets(spark, monkeypatch):
    monkeypatch.setattr("corpusmill.llm.topk.FAN_IN", 2)
    rows = [(i, "q" if i % 3 else "r", i % 40, float(i % 17), 5) for i in range(600)]
    got = best_chunks(spark.createDataFrame(rows, SCHEMA).repartition(9)).where("question_id = 'q'").orderBy("rank").collect()
    best = {}
    for _, q, c, s, _ in rows:
        if q == "q":
            best[c] = max(s, best.get(c, s))
    assert [(x.chunk_id, x.score) for x in got] == [(c, s) for c, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]]
    assert best_chunks(spark.createDataFrame([(1, "q", 1, 1.0, 0), (2, "r", 1, 1.0, None)], SCHEMA)).count() == 0


def test_no_rows_give_no_chunks(spark):
    assert best_chunks(spark.createDataFrame([], SCHEMA)).count() == 0
