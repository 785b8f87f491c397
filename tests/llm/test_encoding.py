import random

import numpy as np
import pytest

from corpusmill.llm import encoding
from corpusmill.llm.encoding import CHAINS, _buckets, _pair, garble, passages, prose, restored, undo

CLEAN = [
    "Às vezes também o gráfico só lê a opção padrão.", "A política de retenção não é obrigatória.", "Für die Rückmeldung ändert sich nichts, außer dass die Größe zählt.", "Möglicherweise überschreibt der Prüflauf den Körper.",
    "Ce réglage n’a guère d’effet sur la mémoire partagée.", "The long table — not the short one — decides what “each” may hold.", "Нельзя удалять Ronex, пока раздел и служба открыты.", "The operators Â and Ê act on it, while Ã is kept for the widths in Å.",
]
SCHEMA = "doc_id bigint, text string, n_chars bigint"


def test_running_text_is_what_is_neither_fenced_nor_between_backticks():
    text = "a `é` b ``x`é`` c `d\n\n```py\né\n````\ne ~~~ f\n~~~\né ```\n~~~\ng `h\n"
    kept = "".join(text[a:b] for a, b in prose(text))
    assert kept == "a  b  c `d\n\n\ne ~~~ f\n\ng `h\n"
    assert prose("x ` y") == [(0, 5)] and "".join("a `b\nc` d"[a:b] for a, b in prose("a `b\nc` d")) == "a  d"
    assert "".join("```\né"[a:b] for a, b in prose("```\né")) == ""


def test_keys_are_the_words_around():
    assert list(passages("Às vezes também o gráfico")) == [("\0vezes", "^Às v"), ("tamb\0fico", "bém o gráf")]


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "latin-1", "utf-8", "latin-1"), ("cp1252", "mac-roman"), ("utf-8", "cp1250")])
def test_chains_are_undone(chain):
    assert undo(garble("été", chain), chain) == "été" and garble("été", chain) != "été"


def test_both_ways_to_a_bucket_agree():
    text = "aé9—\tßЖ漢"
    assert [tuple(x) for x in _buckets([text])] == [x for x in map(_pair, text, text[1:]) if x]


def test_learned_chains_restore_texts_without_a_twin(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(CLEAN) for _ in range(4)) for _ in range(300)]
    chains = [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "latin-1", "utf-8", "latin-1"), ("koi8-r", "cp1251")]
    rows, truth = [(i, t, None) for i, t in enumerate(texts)], {}
    for i in range(24):
        chain = chains[i % 4]
        whole = CLEAN[6] + f" Раздел {i} и служба Ronex." if chain[0] == "koi8-r" else f"Só a fun{i} opção é lida — não. " + rng.choice(CLEAN[:5])
        truth[1000 + i] = whole
        rows.append((1000 + i, garble(whole, chain), i))
    rows += [(2000, None, 1), (2001, "", 1), (2002, "plain", None), (2003, "Strings such as `Ã©` mean that the file was opened wrongly.", 0), (2004, "```\nâ€™ Ã©\n```", 0), (2005, "lost �bersicht", 0), (None, "é", 0), (2005, "lost �bersicht", 0)]
    got = restored(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(x.doc_id for x in got) == sorted([*truth, 2005, 2005])
    assert [(x.chain, x.restored) for x in got if x.doc_id < 2000 and x.restored != truth[x.doc_id]] == []
    assert all(x.restored is None for x in got if x.doc_id == 2005)


def test_a_twin_teaches_however_many_are_more_frequent(spark):
    texts = [f"Dann folgt {c} vor Ende." for c in "àâäãåæçñóô" for _ in range(3)] + ["Dann folgt é vor Ende."] * 2 + [f"Wert{i} hinter Zahl{i} é und é danach{i}." for i in range(200)]
    texts += ["Dann folgt Ã© vor Ende.", "Sonst Ã© niemals Ã© wieder Ã© gesehen."]
    got = restored(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert [(x.chain, x.restored) for x in got if x.doc_id == len(texts) - 1] == [("utf-8>cp1252", "Sonst é niemals é wieder é gesehen.")]
    assert sorted(x.doc_id for x in got) in ([len(texts) - 1], [len(texts) - 2, len(texts) - 1])


@pytest.mark.parametrize("paired", [0, 32])
def test_all_runs_of_all_near_twins_vote(spark, monkeypatch, paired):
    monkeypatch.setattr(encoding, "PAIRED", paired)
    rng = random.Random(5)
    clean = ["é", "à", "—", "’", "ß", "öß", "°", "×", "Раздел", "служба", "文字", "设定", "한국"]
    found: dict[tuple[int, str], int] = {}
    for _ in range(120):
        runs = [rng.choice(clean) for _ in range(rng.choice([1, 1, 3]))]
        found[rng.choice([1, 2]), f"a {', '.join(runs)} z"] = rng.choice([3, 5])
        chain = rng.choice([("utf-8", "cp1252"), ("utf-8", "gbk"), ("koi8-r", "cp1251"), ("gbk", "cp1252"), ("utf-8", "latin-1", "utf-8", "latin-1"), ("cp1252", "mac-roman")])
        found[rng.choice([1, 2]), f"a {', '.join(garble(x, chain) or x for x in runs)} z"] = rng.choice([1, 3])
    found[1, "a é, é, — z"], found[1, "a Ã©, Ã©, â€” z"], found[0, "a € z"], found[0, "a â‚¬ z"], found[1, "a �, é z"] = 5, 1, 5, 1, 1
    most: dict[tuple[int, int, int, str], int] = {}
    chains: dict[tuple[int, int, int, str, str], list[str]] = {}
    for (key, x), n in found.items():
        for (other_key, y), m in found.items():
            xs, ys = x[2:-2].split(", "), y[2:-2].split(", ")
            if key and key == other_key and m <= n and "�" not in x + y and len(xs) == len(ys):
                for i, (a, b) in enumerate(zip(xs, ys)):
                    place = key, len(xs), i
                    most[*place, a] = max(n, most.get((*place, a), 0))
                    if a != b and (*place, a, b) not in chains:
                        chains[*place, a, b] = [">".join(c) for c in CHAINS if garble(a, c) == b]
    made = {x for x, c in chains.items() if c}
    both = {(*p, b, c) for *p, a, b in made for *q, a2, c in made if p == q and a == a2 and (*p, b, c) in made and most[*p, a] > most[*p, b]}
    want = {(a, b, c) for *p, a, b in made - both for c in chains[*p, a, b]}
    rows = spark.createDataFrame([(k, p, n) for (k, p), n in found.items()], "key bigint, passage string, n bigint")
    assert {tuple(x) for x in encoding._votes(rows).collect()} == want and len(want) > 50 and both


def test_no_rows(spark):
    assert restored(spark.createDataFrame([], SCHEMA)).count() == 0
    assert np.array(_buckets([])).shape == (0, 2)
