"""A folder of .md, .txt and .py files as a table, with files whose names begin with a dot or an underscore.

Spark's own file sources leave those out, and empty files, too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.errors import LoadError

EXTENSIONS = ("md", "txt", "py")
_SCHEMA = "file_path string, ext string, content string, line_offsets array<int>, error string"


class _Paths(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path") or "."
        self.extensions = [x.strip() for x in options.get("extensions", ",".join(EXTENSIONS)).split(",")]
        self.parts = max(int(options.get("partitions", 16)), 1)

    def partitions(self) -> list[InputPartition]:
        """The paths, in lists of about equal size in bytes."""
        import heapq
        import os

        found = []
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.rpartition(".")[2] in self.extensions and "." in name:
                    path = os.path.join(folder, name)
                    if os.path.isfile(path):
                        found.append((os.path.getsize(path), path))
        loads = [(0, i, []) for i in range(min(self.parts, max(len(found), 1)))]
        for size, path in sorted(found, reverse=True):
            load, i, held = heapq.heappop(loads)
            held.append(path)
            heapq.heappush(loads, (load + size + 4096, i, held))
        return [_Paths(held) for _, _, held in loads]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from itertools import accumulate
        from pathlib import Path

        for name in partition.paths:
            path = Path(name)
            ext = name.rpartition(".")[2]
            try:
                text = path.read_text(encoding="utf-8")
            except (OSError, UnicodeDecodeError) as e:
                yield path.as_posix(), ext, None, None, f"{type(e).__name__}: {e}"
                continue
            sizes = [len(x) for x in text.splitlines(keepends=True)]
            yield path.as_posix(), ext, text, list(accumulate(sizes[:-1], initial=0)) if sizes else [], None


class Corpus(DataSource):
    """spark.read.format("corpus").load(folder); options: extensions, partitions.

    A file that isn't UTF-8, or can't be opened, has no content but an error.  The folder must
    be one that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, partitions: int | None = None) -> DataFrame:
    """file_path, ext, content, line_offsets, error of every file below the folder."""
    spark.dataSource.register(Corpus)
    reader = spark.read.format("corpus").option("extensions", ",".join(extensions)).option("partitions", partitions or spark.sparkContext.defaultParallelism)
    return reader.load(folder)


def load_files(spark: SparkSession, folder: str = "data/raw") -> DataFrame:
    """The readable files below the folder; LoadError if there is none."""
    files = scan(spark, folder).where("error is null").drop("error")
    if files.isEmpty():
        raise LoadError(f"there is no .md, .txt or .py file to read below {folder}")
    return files


def unreadable_files(spark: SparkSession, folder: str) -> DataFrame:
    """file_path, kind, message of the files that can't be read."""
    return scan(spark, folder).where("error is not null").select("file_path", F.lit("unreadable").alias("kind"), F.col("error").alias("message"))
