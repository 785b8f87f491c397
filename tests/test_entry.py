import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from corpusmill.plans import QUERIES, SQL

ROOT, SMALL = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"
TABLES = ("chunks", "files", "documents", "rag_questions", "search_results")


def shown(value):
    return "" if value is None else f"{value:.6f}" if isinstance(value, float) else str(value)


def test_entry_gives_rows(spark):
    assert e.entry(spark).limit(1).count() == 1 and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, name):
    rows = QUERIES[name](spark, SMALL)
    names = sorted(rows.columns)
    got = sorted(tuple(map(shown, x)) for x in rows.select(*names).collect())
    if name not in SQL:
        assert got and len(set(got)) == len(got)
        return
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    expected = db.execute(f"select {', '.join(names)} from ({SQL[name]})").fetchall()
    assert got == sorted(tuple(map(shown, x)) for x in expected)


def test_the_rest_works_without_the_training_data_folders(tmp_path):
    for path in ROOT.rglob("*.py"):
        name = path.relative_to(ROOT)
        if "llm" not in name.parts and ".git" not in name.parts:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_bytes(path.read_bytes())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert "bm25_topk" in said.stdout and "p1_found" not in said.stdout
