import json

import pytest

from corpusmill import pipeline
from corpusmill.__main__ import run
from corpusmill.errors import LoadError
from corpusmill.operators.bm25 import Index
from corpusmill.schemas import DATASET, FILES, RESULTS
from corpusmill.sources import datasets
from corpusmill.sources.corpus import load_files, scan, unreadable_files
from corpusmill.streaming.chunks import chunk_stream, write_chunks

GREETER = 'class Greeter:\n    """Says hello to people."""\n\n    def greet(self, name):\n        return f"hello {name}"\n'


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "raw"
    for name, data in {
        "a.py": GREETER.encode(), "pkg/__init__.py": b"", "pkg/.hidden.py": b"x = 1\n", "b.md": b"# Serving\r\n\r\nStart the server.\r\n", "c.txt": b"plain text", "empty.txt": b"", "bad.py": b"\xff\xfe", "d.json": b"{}", "E.PY": b"x", "bom.py": b"\xef\xbb\xbfx = 1", "py": b"x",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_scan_reads_what_a_reader_in_text_mode_reads(spark, folder):
    rows = {x.file_path.removeprefix(f"{folder}/"): x for x in scan(spark, str(folder)).collect()}
    assert sorted(rows) == ["a.py", "b.md", "bad.py", "bom.py", "c.txt", "empty.txt", "pkg/.hidden.py", "pkg/__init__.py"]
    assert rows["b.md"].content == "# Serving\n\nStart the server.\n" and rows["b.md"].line_offsets == [0, 10, 11]
    assert rows["empty.txt"].content == "" and rows["empty.txt"].line_offsets == [] and rows["bom.py"].content == "\ufeffx = 1"
    assert rows["bad.py"].content is None and "UnicodeDecodeError" in rows["bad.py"].error
    assert [x.file_path for x in unreadable_files(spark, str(folder)).collect()] == [f"{folder}/bad.py"]
    assert {x.ext for x in scan(spark, str(folder), ("md",)).collect()} == {"md"} and load_files(spark, str(folder)).count() == 7


def test_no_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    for path in (tmp_path, tmp_path / "none"):
        with pytest.raises(LoadError):
            load_files(spark, str(path))


@pytest.mark.parametrize(
    ("document", "schema", "part"),
    [
        ("{", DATASET, "no JSON"), ("[]", DATASET, "$ is no object"), ('{"rag_questions": 1}', DATASET, "no list"), ('{"rag_questions": [{"question": 42}]}', DATASET, "question is no text"), ('{"rag_questions": [{"question_id": "a"}]}', DATASET, "question is no text"),
        ('{"rag_questions": [{"question": "a", "sources": [{"file_path": "a", "first_character_index": "x", "last_character_index": 2}]}]}', DATASET, "first_character_index is no whole number"),
        ('{"search_results": [], "k": "many"}', RESULTS, "k is no whole number"), ('{"search_results": [{"question_id": "a", "question": "b", "retrieved_sources": null}], "k": 1}', RESULTS, "no list"), ('{"search_results": []}', RESULTS, "k is no"),
    ],
)
def test_wrong_documents_are_refused(document, schema, part):
    with pytest.raises(LoadError, match=part.replace("$", r"\$")):
        datasets.parse(document, schema, frozenset() if schema == RESULTS else datasets._OPTIONAL)


def test_whole_numbers_may_be_text():
    value = datasets.parse('{"search_results": [{"question_id": "a", "question": "b", "retrieved_sources": [{"file_path": "f", "first_character_index": "23", "last_character_index": 24.0}]}], "k": 1}', RESULTS, frozenset())
    assert value["search_results"][0]["retrieved_sources"][0] == {"file_path": "f", "first_character_index": 23, "last_character_index": 24}


def test_from_folder_to_recall(spark, folder, tmp_path):
    index = f"{tmp_path}/index"
    pipeline.index(spark, str(folder), index, 2000)
    assert Index(spark, index).ask("What does the greeter say to people?", 1).first().file_path.endswith("a.py")
    asked = {"rag_questions": [{"question_id": "q1", "question": "How to start the server?", "sources": [{"file_path": f"{folder}/b.md", "first_character_index": 11, "last_character_index": 20}], "answer": "start"}, {"question": "nothing xyzzy"}]}
    (tmp_path / "set.json").write_text(json.dumps(asked))
    found = pipeline.search_dataset(spark, f"{tmp_path}/set.json", 3, f"{tmp_path}/out", index)
    rows, k = datasets.read_results(spark, found)
    by = {x.question: x for x in rows.collect()}
    assert k == 3 and by["How to start the server?"].question_id == "q1" and by["How to start the server?"].retrieved_sources[0].file_path.endswith("b.md") and by["nothing xyzzy"].retrieved_sources == []
    replies = pipeline.answer_dataset(spark, found, f"{tmp_path}/answers", index)
    held, _ = datasets.read_results(spark, replies, answers=True)
    assert {x.question: x.answer for x in held.collect()} == {"How to start the server?": "# Serving", "nothing xyzzy": ""}
    assert pipeline.answer(spark, "server", 1, index) == "# Serving"
    row = pipeline.evaluate(spark, found, f"{tmp_path}/set.json").first()
    assert row.n_questions == 1 and row.recall_at_1 == 1.0 and row.passed
    assert not pipeline.evaluate(spark, found, f"{tmp_path}/set.json", context=5).first().passed
    assert {x.ext: (x.n_files, x.n_chunks) for x in pipeline.chunk_metrics(spark, str(folder)).collect()} == {"py": (4, 3), "md": (1, 1), "txt": (2, 1)}


def test_commands(spark, folder, tmp_path, capsys):
    index = f"{tmp_path}/index"
    assert run(["search", "x", "--index", index]) == 1 and "IndexingError" in capsys.readouterr().err
    assert run(["index", "--raw", str(folder), "--index", index, "--max_chunk_size", "3000"]) == 1
    assert run(["index", "--raw", str(folder), "--index", index, "--max_chunk_size", "100"]) == 0
    assert run(["search", "greeter", "--index", index, "--k", "1"]) == 0 and "a.py" in capsys.readouterr().out
    assert run(["search", "greeter", "--index", index, "--k", "0"]) == 1
    assert run(["chunk_metrics", "--raw", f"{tmp_path}/none"]) == 1


def test_chunks_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a.txt", "txt", "one\n\ntwo", [0, 4, 5]), ("b.py", "py", "print 1", [0])], FILES).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # what was read isn't read again
        write_chunks(chunk_stream(spark, f"{tmp_path}/in", 4), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    assert sorted(x.content for x in spark.read.parquet(f"{tmp_path}/out").collect()) == ["one", "two"]
