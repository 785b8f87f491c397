import random
from collections import Counter
from itertools import combinations

from corpusmill.llm import packing
from corpusmill.llm.packing import TOKENIZER, _encoding, count_tokens, fill, pack, packed


def test_fill_finds_the_fullest_sum():
    rng = random.Random(1)
    for _ in range(200):
        many = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(9)))
        lengths = sorted(many, reverse=True)
        room = rng.randrange(60)
        total, taken = fill(lengths, [many[x] for x in lengths], room)
        every = list(many.elements())
        assert total == max(sum(c) for r in range(len(every) + 1) for c in combinations(every, r) if sum(c) <= room)
        assert sum(x * k for x, k in zip(lengths, taken)) == total and all(k <= many[x] for x, k in zip(lengths, taken))


def first_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        i = next((i for i, r in enumerate(rooms) if r >= x), None)
        if i is None:
            rooms.append(capacity - x)
        else:
            rooms[i] -= x
    return len(rooms)


def test_windows_hold_every_item_once_and_are_as_few_as_those_of_first_fit_or_one_more():
    rng = random.Random(2)
    for _ in range(20):
        items = [(rng.choice([0, 1, 7, 50, rng.randrange(1, 513)]), i) for i in range(300)]
        windows = pack(items, [512])
        assert sorted(x for _, held in windows for x in held) == list(range(300))
        assert all(sum(items[x][0] for x in held) <= size for size, held in windows)
        assert len(windows) <= first_fit_decreasing([x for x, _ in items], 512) + 1
    assert pack([(0, "a")], [512, 64]) == [(64, ["a"])] and pack([], [5]) == []
    assert pack([(60, "a")], [512, 64]) == [(64, ["a"])]


def test_long_texts_have_the_tokens_of_the_whole(monkeypatch):
    encoding = _encoding(TOKENIZER)
    text = "def f(x):\n\n    return 'é漢字'\n  \n\n\nnext line of it\n" * 40
    whole = count_tokens(encoding, text)
    monkeypatch.setattr(packing, "_RUN", 100)
    assert count_tokens(encoding, text) == whole
    assert count_tokens(encoding, "x" * 1000) > 0 and count_tokens(encoding, " \n" * 500) > 0


def test_documents_are_placed_once_within_capacities(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 60)
    rng = random.Random(3)
    texts = [None, "", "", "word " * 9000, *(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 700))) for _ in range(300))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x"), (5, texts[5], "x")], "doc_id bigint, text string, capacity string")
    kinds = spark.createDataFrame([(1, 512), (2, 1024), (3, None), (4, 0), (5, 4096)], "container_id int, capacity int")
    got = packed(docs, kinds).collect()
    assert Counter(x.doc_id for x in got if x.part == 0) == Counter([*range(1, len(texts)), 5])
    parts = sorted((x.part, x.first_token, x.tokens) for x in got if x.doc_id == 3)
    assert [x[0] for x in parts] == [0, 1, 2] and [x[1] for x in parts] == [0, 4096, 8192] and [x[2] for x in parts[:2]] == [4096, 4096]
    windows = {}
    for x in got:
        windows.setdefault((x.window, x.capacity, x.filled), []).append(x.tokens)
    assert all(sum(t) == filled <= capacity and capacity in (512, 1024, 4096) for (_, capacity, filled), t in windows.items())
    assert len({w for w, _, _ in windows}) == len(windows)
    assert sum(f for _, _, f in windows) / sum(c for _, c, _ in windows) > 0.99


def test_nothing_to_place(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packed(docs, spark.createDataFrame([(1, 9)], "container_id int, capacity int")).count() == 0
    assert packed(docs, spark.createDataFrame([], "container_id int, capacity int")).count() == 0
