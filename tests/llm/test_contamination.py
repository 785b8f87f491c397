import random

from corpusmill.llm.contamination import Passages, contaminated, words

TWELVE = "One two three four five six seven eight nine ten eleven twelve"


def test_words():
    assert words("A_b c's École İx 3½") == ["a", "b", "c", "s", "école", "i̇x", "3½"]


def test_twelve_words_in_order_are_found_and_eleven_are_not(spark):
    docs = [(1, TWELVE), (2, TWELVE.rpartition(" ")[0]), (3, "x " * 50 + TWELVE.upper().replace(" ", "_\n--") + " y" * 30), (4, None), (5, ""), (6, TWELVE.replace("six seven", "seven six")), (7, "zero " + TWELVE + " thirteen")]
    items = [(10, "zero " + TWELVE), (11, TWELVE + " thirteen"), (12, "one two"), (13, None)]
    got = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [(d, i) for d in (1, 3, 7) for i in (10, 11)]


def test_search_finds_what_a_plain_search_finds():
    rng = random.Random(4)
    for _ in range(200):
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for i in range(4)]
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(40)))
        plain = {i for i, t in items for j in range(len(t.split()) - 3) if f" {' '.join(t.split()[j : j + 4])} " in f" {text} "}
        assert Passages(items, 4).found(text) == plain


def test_nulls_repeats_blocks_and_other_columns(spark, monkeypatch):
    docs = spark.createDataFrame([(1, TWELVE, 5, "a"), (1, TWELVE, 5, "a"), (None, TWELVE, 6, "a"), (2, "zero " * 100_000 + TWELVE, None, None), (3, "", 1, "b")], "doc_id bigint, text string, item_id bigint, suite string")
    items = spark.createDataFrame([(10, TWELVE, 1), (10, TWELVE, 1), (11, "and " + TWELVE, None), (None, TWELVE, 3), (12, "", 4)], "item_id bigint, text string, doc_id bigint")
    expected = [(d, i) for d in (1, 2) for i in (10, 11)]
    assert sorted(map(tuple, contaminated(docs, items).collect())) == expected
    monkeypatch.setattr("corpusmill.llm.contamination.BLOCK", 60)
    assert sorted(map(tuple, contaminated(docs, items).collect())) == expected
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0
