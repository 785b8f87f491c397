from corpusmill.llm.documentation import code_descriptions, documented_names

SOURCE = '''class Outer:
    def method(self):
        """Gives the width of one row."""
        return 1

    # Counts the rows that were read.
    async def other(self): pass

def bare():
    """Bare."""
'''
FILES = [
    ("a.py", "py", SOURCE, 1),
    ("a.py", "py", SOURCE, 2),
    ("b.py", "py", None, 1),
    ("c.py", "py", "", 1),
    ("d.py", "py", SOURCE + "\nprint 1\n", 1),
    ("e.md", "md", SOURCE, 1),
    ("pkg/__init__.py", "py", SOURCE, None),
]


def test_files_give_pairs_of_code_and_description(spark):
    files = spark.createDataFrame(FILES, "file_path string, ext string, content string, loaded_at int")
    names = [(p, x) for p in ("a.py", "pkg/__init__.py") for x in ("Outer.method", "Outer.other")]
    assert sorted(map(tuple, documented_names(files).collect())) == names
    pairs = sorted(code_descriptions(files).collect())
    assert [(x.file_path, x.qualname) for x in pairs] == names
    assert [x.description for x in pairs[:2]] == ["Gives the width of one row.", "Counts the rows that were read."]
    assert all(x.code == SOURCE[x["first"] : x["last"]] and x.code.startswith(("def method", "async def other")) for x in pairs)


def test_nulls_repeats_long_texts_and_other_columns(spark):
    long = "x = 1\n" * 50_000 + SOURCE
    rows = [(None, "py", SOURCE, "a"), ("a.py", None, SOURCE, "a"), ("a.py", "py", SOURCE, None), ("a.py", "py", SOURCE, None), ("l.py", "py", long, "b")]
    files = spark.createDataFrame(rows, "file_path string, ext string, content string, qualname string")
    assert sorted(map(tuple, documented_names(files).collect())) == [(p, x) for p in ("a.py", "l.py") for x in ("Outer.method", "Outer.other")]
    pairs = code_descriptions(files).collect()
    assert len(pairs) == 4 and all(x.code == long[x["first"] : x["last"]] for x in pairs if x.file_path == "l.py")
    assert documented_names(files.limit(0)).count() == 0 and code_descriptions(files.limit(0)).count() == 0
